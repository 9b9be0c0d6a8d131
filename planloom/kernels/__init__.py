"""Numpy kernels for what is iterative within one capture. Each works on one capture's rows."""
