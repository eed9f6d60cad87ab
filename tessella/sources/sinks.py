"""Output files: names, images, SVG."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extensions that an output keeps.
KNOWN = "bmp|jpeg|jpg|png|svg|tif|tiff|webp"
#: What images can be written as; the second ones have no opacity.
WITH_ALPHA, WITHOUT_ALPHA = ("png", "tif", "tiff"), ("bmp", "jpg", "jpeg")
BAND = 1 << 20  # pixels that a task compresses


def output_path(path: Column, index: Column, total: int, pattern: str, svg: bool = False, default: bool = False) -> Column:
    """The output name for the ``index``-th of ``total`` inputs; ``{n}``, ``{stem}`` and ``{name}`` stand for its number,
    its name without and with extension. Without any of them several outputs get their number before the extension."""
    if total == 1 and default:
        return F.lit("output.svg" if svg else "output.png")
    name = F.element_at(F.split(path, "/"), -1)
    stem = F.when(name.rlike(r"^.+\."), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)
    number = F.lpad(index.cast("string"), len(str(total)), "0")
    out = F.replace(F.replace(F.replace(F.lit(pattern), F.lit("{n}"), number), F.lit("{stem}"), stem), F.lit("{name}"), name)
    if total > 1 and not any(t in pattern for t in ("{n}", "{stem}", "{name}")):
        out = F.when(out.contains("."), F.concat(F.regexp_replace(out, r"\.[^.]*$", ""), F.lit("_"), number, F.regexp_extract(out, r"(\.[^.]*)$", 1))).otherwise(F.concat(out, F.lit("_"), number))
    return F.concat(F.regexp_replace(out, r"\.[^.]*$", ""), F.lit(".svg")) if svg else out


def ensure_extension(path: Column, default: str) -> Column:
    """The path itself if its extension is an image's, else with ``default`` instead."""
    name = F.element_at(F.split(path, "/"), -1)
    has = name.rlike(r"^.+\.")
    return F.when(name.rlike(rf"(?i)^.+\.({KNOWN})$"), path).when(has, F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(f".{default}"))).otherwise(F.concat(path, F.lit(f".{default}")))


def _joined_sums(a: int, b: int, size: int) -> int:
    """Adler-32 of two stretches from that of each; the second has ``size`` bytes."""
    m = 65521  # fixed value
    a1, a2, b1, b2 = a & 0xFFFF, a >> 16, b & 0xFFFF, b >> 16
    return (a2 + b2 + size % m * (a1 - 1)) % m << 16 | (a1 + b1 - 1) % m


def png_bytes(w: int, h: int, bands: list[tuple[bytes, int, int]], channels: int = 3) -> bytes:
    """A PNG file of compressed bands, each with the Adler-32 and size of what it holds."""

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    total = 1
    for _, check, size in bands:
        total = _joined_sums(total, check, size)
    data = b"\x78\x9c" + b"".join(x for x, _, _ in bands) + b"\x03\x00" + struct.pack(">I", total)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[channels], 0, 0, 0)) + chunk(b"IDAT", data) + chunk(b"IEND", b"")


def _bands(px: DataFrame, pack: Callable) -> DataFrame:
    """``(img_id, w, h, band, data, check, size)``: rows of pixels packed in bands of about ``BAND`` pixels."""
    names = ["r", "g", "b", "a"] if "a" in px.columns else ["r", "g", "b"]

    def run(frame):
        import numpy as np
        import pandas as pd

        w, h, band = (int(frame[k].iloc[0]) for k in ("w", "h", "band"))
        rows = max(1, BAND // w)
        out = np.zeros((min(rows, h - band * rows), w, len(names)), np.uint8)
        out[frame["y"] - band * rows, frame["x"]] = frame[names].to_numpy()
        data, check, size = pack(out)
        return pd.DataFrame([{"img_id": frame["img_id"].iloc[0], "w": w, "h": h, "band": band, "data": data, "check": check, "size": size}])

    at = px.withColumn("band", F.floor(F.col("y") / F.greatest(F.floor(F.lit(BAND) / F.col("w")), F.lit(1))).cast("int"))
    return at.groupBy("img_id", "band").applyInPandas(run, "img_id string, w int, h int, band int, data binary, check long, size long")


def _deflated(rows) -> tuple[bytes, int, int]:
    raw = b"".join(b"\0" + r.tobytes() for r in rows)  # a filter byte, none, before each row
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(raw) + c.flush(zlib.Z_FULL_FLUSH), zlib.adler32(raw), len(raw)


def _plain(rows) -> tuple[bytes, int, int]:
    return rows.tobytes(), 0, rows.size


def _bmp(rows) -> tuple[bytes, int, int]:
    """Blue first, rows from below, each filled up to four bytes."""
    end = b"\0" * (-rows.shape[1] * 3 % 4)
    return b"".join(r[:, 2::-1].tobytes() + end for r in rows[::-1]), 0, rows.size


def bmp_bytes(w: int, h: int, bands: list[tuple[bytes, int, int]], channels: int = 3) -> bytes:
    data = b"".join(x for x, _, _ in reversed(bands))
    return struct.pack("<2sIHHI", b"BM", 54 + len(data), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(data), 2835, 2835, 0, 0) + data


def tiff_bytes(w: int, h: int, bands: list[tuple[bytes, int, int]], channels: int = 3) -> bytes:
    """One strip, not compressed. Tags are number, kind (3: two bytes, 4: four), count and value."""
    data = b"".join(x for x, _, _ in bands)
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, channels, 8 + len(data)), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 8), (277, 3, 1, channels), (278, 4, 1, h), (279, 4, 1, len(data))]
    tags += [(338, 3, 1, 2)] if channels == 4 else []  # opacity that colours are not multiplied with
    depths = struct.pack("<4H", 8, 8, 8, 8)
    return struct.pack("<2sHI", b"II", 42, 8 + len(data) + len(depths)) + data + depths + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)


def encode(px: DataFrame, kind: str = "png") -> DataFrame:
    """``(img_id, w, h, data)``: image files. Bands are packed in tasks of their own; what makes a file of them only joins
    them. ``kind`` is an extension; JPEG comes as PNG here, ``write_files`` has the JVM turn it."""
    if kind not in WITH_ALPHA + WITHOUT_ALPHA:
        raise ValueError(f"images cannot be written as {kind}")
    pack, whole = {"bmp": (_bmp, bmp_bytes), "tif": (_plain, tiff_bytes), "tiff": (_plain, tiff_bytes)}.get(kind, (_deflated, png_bytes))
    channels = 4 if "a" in px.columns else 3
    if kind in WITHOUT_ALPHA and channels == 4:
        raise ValueError(f"{kind} has no opacity, lay the image over a background first")

    def run(frame):
        import pandas as pd

        frame = frame.sort_values("band")
        w, h = int(frame["w"].iloc[0]), int(frame["h"].iloc[0])
        parts = [(bytes(d), int(c), int(n)) for d, c, n in zip(frame["data"], frame["check"], frame["size"], strict=True)]
        return pd.DataFrame([{"img_id": frame["img_id"].iloc[0], "w": w, "h": h, "data": whole(w, h, parts, channels)}])

    return _bands(px, pack).groupBy("img_id").applyInPandas(run, "img_id string, w int, h int, data binary")


def encode_png(px: DataFrame) -> DataFrame:
    return encode(px, "png").withColumnRenamed("data", "png")


def _as_jpeg(jvm, data: bytes) -> bytes:
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    out = jvm.java.io.ByteArrayOutputStream()
    if not jvm.javax.imageio.ImageIO.write(image, "jpg", out):
        raise ValueError("the JVM cannot write JPEG")
    return bytes(out.toByteArray())


def write_files(rows: DataFrame, path: str, data: str) -> None:
    """Write a file for each row through the file system that Spark writes to. Python tasks have no such file system, so
    contents pass the driver, one at a time. Names that end in jpg or jpeg get JPEG."""
    spark = rows.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in rows.select(path, data).toLocalIterator():
        content = r[1].encode() if isinstance(r[1], str) else bytes(r[1])
        if r[0].lower().endswith((".jpg", ".jpeg")) and content[:4] == b"\x89PNG":
            content = _as_jpeg(jvm, content)
        to = jvm.org.apache.hadoop.fs.Path(r[0])
        out = to.getFileSystem(conf).create(to, True)
        try:
            out.write(content)
        finally:
            out.close()


def svg_documents(lines: DataFrame) -> DataFrame:
    """``(img_id, svg)`` from lines in order."""
    all_ = F.sort_array(F.collect_list(F.struct("place", "element")))
    return lines.groupBy("img_id").agg(F.concat(F.array_join(F.transform(all_, lambda e: e["element"]), "\n"), F.lit("\n")).alias("svg"))
