"""Training-data operators. Nothing outside this folder imports it; the driver
file adds its queries only when the folder is there."""
