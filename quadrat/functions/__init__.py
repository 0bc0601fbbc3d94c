"""NumPy kernels that run inside Arrow functions, one image, cloud or block at a time."""
