"""NumPy kernels that run on one topology at a time, inside grouped Arrow functions."""
