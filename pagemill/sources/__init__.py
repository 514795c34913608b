"""Scans: table readers and the HTML / XML parse kernels that produce node and token rows."""
