"""Raster formats: for each a module with parse(reader, record) and decode(reader, record, limits) -> pixels (height, width, channels)."""

from rasterlake.operators.formats import bmp, gif, jpeg, pcx, png, tiff

REGISTRY = {"BMP": bmp, "PNG": png, "JPEG": jpeg, "GIF": gif, "TIFF": tiff, "PCX": pcx}
