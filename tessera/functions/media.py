"""Media helpers: formats, geometry, colour, sound, encodings; plain expressions where Spark has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAGIC = (("png", "89504E47"), ("jpeg", "FFD8FF"), ("gif", "47494638"), ("pdf", "25504446"), ("zip", "504B0304"), ("wav", "52494646"), ("ogg", "4F676753"), ("mp3", "494433"), ("bmp", "424D"), ("flac", "664C6143"))
EXTENSIONS = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "json": "application/json", "csv": "text/csv", "xml": "application/xml", "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4", "py": "text/x-python", "rs": "text/x-rust", "js": "text/javascript", "css": "text/css", "yaml": "application/yaml", "yml": "application/yaml", "toml": "application/toml"}


def format_of(data: Column) -> Column:
    """Format by the first bytes; null if unknown."""
    head = F.hex(F.substring(data, 1, 8))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, sign in MAGIC:
        out = out.when(head.startswith(sign), name)
    return out


def mime_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.lit("application/octet-stream"))


def box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, relative: bool) -> Column:
    """A bounding box in pixels as shares of the picture (relative), or the other way round."""
    a, b = (width, height)
    return F.struct(*[(v / s if relative else v * s).alias(n) for n, v, s in (("x", x, a), ("y", y, b), ("w", w, a), ("h", h, b))])


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def hsv(r: Column, g: Column, b: Column) -> Column:
    """Hue in degrees, saturation and value from 0 to 1, of channels from 0 to 255."""
    top, low = F.greatest(r, g, b) / 255, F.least(r, g, b) / 255
    d = top - low
    hue = F.when(d == 0, 0.0).when(top == r / 255, F.pmod((g - b) / 255 / d, F.lit(6.0))).when(top == g / 255, (b - r) / 255 / d + 2).otherwise((r - g) / 255 / d + 4) * 60
    return F.struct(hue.alias("h"), F.when(top == 0, 0.0).otherwise(d / top).alias("s"), top.alias("v"))


def resample(samples: Column, from_rate: int, to_rate: int) -> Column:
    """Linear interpolation at another rate."""
    n = F.size(samples)
    m = F.greatest(F.floor(n * to_rate / from_rate).cast("int"), F.lit(1))

    def at(i):
        x = i * (from_rate / to_rate)
        k = F.floor(x).cast("int")
        a, b = F.get(samples, F.least(k, n - 1)), F.get(samples, F.least(k + 1, n - 1))
        return a + (b - a) * (x - k)

    return F.transform(F.sequence(F.lit(0), m - 1), at)


def mono(samples: Column) -> Column:
    """Interleaved stereo to one channel."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(samples) / 2).cast("int") - 1), lambda i: (F.get(samples, 2 * i) + F.get(samples, 2 * i + 1)) / 2)


def peak_normalize(samples: Column) -> Column:
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return F.when(peak == 0, samples).otherwise(F.transform(samples, lambda x: x / peak))


def encoding_of(data: Column) -> Column:
    head = F.hex(F.substring(data, 1, 3))
    return F.when(head == "EFBBBF", "utf-8-bom").when(head.startswith("FFFE"), "utf-16le").when(head.startswith("FEFF"), "utf-16be").when(F.is_valid_utf8(data), "utf-8").otherwise("latin-1")
