"""Operators: pair domains, comparators, k-mers, images, point clouds, signals, clustering."""
