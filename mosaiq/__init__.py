"""WebP images and their pixels as Spark DataFrames."""

from mosaiq.codec import WebpError
from mosaiq.codec.lossless import Image, Options
from mosaiq.functions import alpha_decode, alpha_encode, register, riff_build, webp_decode, webp_encode, webp_info
from mosaiq.sources import read_webp, write_webp
from mosaiq.streaming import stream_webp

__all__ = ["Image", "Options", "WebpError", "alpha_decode", "alpha_encode", "read_webp", "register", "riff_build", "stream_webp", "webp_decode", "webp_encode", "webp_info", "write_webp"]
