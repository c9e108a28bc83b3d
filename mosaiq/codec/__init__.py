"""Image codec kernels without any Spark: bytes and NumPy arrays in, bytes and NumPy arrays out."""


class WebpError(ValueError):
    """A file that can't be read, or an image that can't be written."""
