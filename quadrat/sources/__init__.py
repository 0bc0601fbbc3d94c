"""Sources: FASTA, images, particle files, and folders of files."""
