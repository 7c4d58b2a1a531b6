"""Media columns: TIFF. A reader that gives one row a page, and the writer that the round trip needs.

The reader walks the chain of image directories (either byte order), decodes strips or tiles that are stored plain,
as PackBits, LZW or deflate, unpacks samples of 1, 2, 4, 8, 16, 32 or 64 bits in either fill order, undoes horizontal differencing and the
floating-point predictor and returns the samples of each page, row by row, the lowest byte of a sample first.

Not read, with an error row: BigTIFF, samples of other sizes or of different sizes in a page, JPEG, CCITT and old-style LZW.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumiform.llm.common import chunks, table

#: TIFF tags.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES, FORMAT, FILL_ORDER = 317, 322, 323, 324, 325, 339, 266
#: Predictors (none, horizontal differencing, floating point), and sample formats (unsigned, signed, floating point, undefined).
NONE, HORIZONTAL, FLOATING = 1, 2, 3
UNSIGNED, SIGNED, IEEE, UNDEFINED = 1, 2, 3, 4
#: Fixed value: the fill order in which a byte's lowest bit comes first; such bytes are turned round as they are read.
LOWEST_FIRST = 2
TURNED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
#: Bytes of a page's samples that the reader gives at most: what a binary column can hold.
LARGEST = (1 << 31) - 1
#: Codes of compressions.
PLAIN, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
#: Struct codes of field types.
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}


class TiffError(ValueError):
    pass


# -- codecs


def packbits_decode(data: bytes, limit: int = LARGEST) -> bytes:
    out, at, n = bytearray(), 0, len(data)
    while at < n and len(out) < limit:
        head = data[at]
        at += 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        elif head > 128:
            out += data[at : at + 1] * (257 - head)
            at += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of 3 bytes or more as repeats, the rest as literals of up to 128 bytes."""
    x = np.frombuffer(data, np.uint8)
    starts = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1]) if len(x) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(x)))
    out, at = bytearray(), 0

    def literal(to: int) -> None:
        for i in range(at, to, 128):
            part = data[i : min(i + 128, to)]
            out.append(len(part) - 1)
            out.extend(part)

    for k in np.flatnonzero(sizes >= 3).tolist():
        a, size = int(starts[k]), int(sizes[k])
        literal(a)
        for i in range(0, size, 128):
            n = min(128, size - i)
            out += bytes((257 - n if n > 1 else 0, data[a]))
        at = a + size
    literal(len(data))
    return bytes(out)


CLEAR, END, FIRST, WIDEST = 256, 257, 258, 12


def lzw_decode(data: bytes, limit: int = LARGEST) -> bytes:
    """LZW as in TIFF: most significant bit first; codes widen one code early."""
    out, words, width = bytearray(), [], 9
    acc = bits = 0
    last = b""
    singles = [bytes((i,)) for i in range(256)] + [b"", b""]
    words = singles.copy()
    for byte in data:
        acc = (acc << 8 | byte) & 0xFFFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits & ((1 << width) - 1)
        if code == CLEAR:
            words, width, last = singles.copy(), 9, b""
        elif code == END:
            break
        else:
            if not last:
                if code >= len(words):
                    raise TiffError("LZW: unknown code")
                word = words[code]
            elif code < len(words):
                word = words[code]
                words.append(last + word[:1])
            elif code == len(words):
                word = last + last[:1]
                words.append(word)
            else:
                raise TiffError("LZW: unknown code")
            out += word
            if len(out) >= limit:
                break
            last = word
            if len(words) >= (1 << width) - 1 and width < WIDEST:
                width += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Words of the table are known by the code of all but their last byte, and that byte, so a step costs the same however long they are."""
    acc, bits, out = CLEAR, 9, bytearray()
    codes: dict[int, int] = {}
    width, size, known = 9, FIRST, codes.get
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        longer = prefix << 8 | byte
        code = known(longer)
        if code is not None:
            prefix = code
            continue
        acc, bits = acc << width | prefix, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1
        codes[longer] = size
        size += 1
        prefix = byte
        if size >= 1 << width:
            width += 1
        if size >= (1 << WIDEST) - 2:
            acc, bits = acc << width | CLEAR, bits + width
            codes.clear()
            width, size = 9, FIRST
    if prefix >= 0:
        acc, bits = acc << width | prefix, bits + width
        size += 1
        if size >= 1 << width and width < WIDEST:
            width += 1
    acc, bits = acc << width | END, bits + width
    acc, bits = acc << (-bits % 8), bits + -bits % 8
    return bytes(out) + acc.to_bytes(bits // 8, "big")


def inflate(data: bytes, limit: int = LARGEST) -> bytes:
    return zlib.decompressobj().decompress(data, limit)


#: Each reads at least `limit` bytes where there are so many, and not much more.
DECODERS = {PLAIN: lambda x, limit: x, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: packbits_decode}
ENCODERS = {PLAIN: bytes, LZW: lzw_encode, DEFLATE: lambda x: zlib.compress(x, 1), PACKBITS: packbits_encode}


# -- reading


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """The byte order and fields of every image directory, along the chain; a chain that returns to itself ends."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise TiffError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        if at + 2 > len(data):
            raise TiffError("directory outside the file")
        count = struct.unpack_from(order + "H", data, at)[0]
        fields = {}
        if at + 2 + 12 * count + 4 > len(data):
            raise TiffError("directory outside the file")
        for i in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind not in TYPES:
                continue
            code = f"{n * len(TYPES[kind])}{TYPES[kind][0]}"
            size = struct.calcsize(order + code)
            where = at + 2 + 12 * i + 8 if size <= 4 else struct.unpack_from(order + "I", data, at + 2 + 12 * i + 8)[0]
            if where + size > len(data):
                raise TiffError(f"field {tag} outside the file")
            if not n:
                continue
            fields[tag] = struct.unpack_from(order + code, data, where)
        yield order, fields
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def unpacked(raw: bytes, bits: int, tall: int, values: int, order: str) -> np.ndarray:
    """Rows of `values` samples each; samples of less than a byte fill bytes from their highest bit, and a row begins with a byte."""
    if bits >= 8:
        return np.frombuffer(raw, f"{order}u{bits // 8}", tall * values).reshape(tall, values)
    line = -(-values * bits // 8)
    split = np.unpackbits(np.frombuffer(raw, np.uint8, tall * line).reshape(tall, line), axis=1)[:, : values * bits].reshape(tall, values, bits)
    return (split << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)


def unpredicted(block: np.ndarray, raw: bytes, predictor: int, bits: int) -> np.ndarray:
    """block (height, width, samples) with its predictor undone. The floating-point one has differences of bytes, the highest bytes of a row first."""
    if predictor == HORIZONTAL:
        out = np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
        return out & np.uint8((1 << bits) - 1) if bits < 8 else out
    if predictor == FLOATING:
        tall, across, depth = block.shape
        size = bits // 8
        line = np.frombuffer(raw, np.uint8, tall * across * depth * size).reshape(tall, -1, depth)
        planes = np.cumsum(line, axis=1, dtype=np.uint8).reshape(tall, size, across * depth)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">u{size}").reshape(block.shape)
    return block


def decode_page(data: bytes, order: str, fields: dict[int, tuple]) -> np.ndarray:
    """Samples of a page: an array of height, width, samples, little-endian, of the kind that the sample format names (signed samples of less than a byte
    and undefined ones are given as unsigned). What the header says is held against the file before anything is allocated."""
    one = lambda tag, other: fields.get(tag, (other,))[0]
    width, height, samples, bits = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), one(BITS, 1)
    code, predictor = one(COMPRESSION, PLAIN), one(PREDICTOR, NONE)
    if any(not isinstance(x, int) or x < 1 for x in (width, height, samples)):
        raise TiffError("a page without size")
    if bits not in (1, 2, 4, 8, 16, 32, 64) or len(set(fields.get(BITS, (bits,)))) > 1:
        raise TiffError(f"{bits} bits a sample aren't supported")
    if one(FILL_ORDER, 1) not in (1, LOWEST_FIRST):
        raise TiffError(f"fill order {one(FILL_ORDER, 1)} is unknown")
    told = one(FORMAT, UNSIGNED)
    if told not in (UNSIGNED, SIGNED, IEEE, UNDEFINED) or (told == IEEE and bits < 16):
        raise TiffError(f"sample format {told} isn't supported for {bits} bits")
    if code not in DECODERS:
        raise TiffError(f"compression {code} isn't supported")
    if predictor not in (NONE, HORIZONTAL, FLOATING) or (predictor == FLOATING and (bits < 16 or one(FORMAT, 1) != IEEE)):
        raise TiffError(f"predictor {predictor} isn't supported")
    kind = np.dtype(f"{order}u{max(bits // 8, 1)}")
    if width * height * samples * kind.itemsize > LARGEST:
        raise TiffError("a page of more bytes than a column holds")
    apart = one(PLANAR, 1) == 2 and samples > 1
    depth, planes = (1, samples) if apart else (samples, 1)
    tiled = TILE_AT in fields
    across = one(TILE_WIDTH, 0) if tiled else width
    down = one(TILE_HEIGHT, 0) if tiled else min(one(STRIP_ROWS, height), height)
    if any(not isinstance(x, int) or x < 1 for x in (across, down)):
        raise TiffError("strips or tiles without size")
    need = (-(-across * depth * bits // 8)) * down
    if need > LARGEST:
        raise TiffError("strips or tiles of more bytes than a column holds")
    places, sizes = (fields.get(t) for t in ((TILE_AT, TILE_BYTES) if tiled else (STRIP_AT, STRIP_BYTES)))
    columns, rows = -(-width // across), -(-height // down)
    if not places or not sizes or len(places) != len(sizes) or len(places) < columns * rows * planes:
        raise TiffError("strips or tiles are missing")
    blocks = []
    for i, (at, size) in enumerate(zip(places[: columns * rows * planes], sizes, strict=False)):
        y = i % (columns * rows) // columns * down
        tall = down if tiled else min(down, height - y)
        if at < 0 or size < 0 or at + size > len(data):
            raise TiffError("a strip or tile outside the file")
        stored = data[at : at + size]
        if one(FILL_ORDER, 1) == LOWEST_FIRST:
            stored = stored.translate(TURNED)
        try:
            raw = DECODERS[code](stored, max(need, 1))
        except zlib.error as e:
            raise TiffError(str(e)) from e
        if len(raw) < (-(-across * depth * bits // 8)) * tall:
            raise TiffError("a strip or tile is too short")
        block = unpacked(raw, bits, tall, across * depth, order).reshape(tall, across, depth)
        blocks.append(unpredicted(block, raw, predictor, bits)[: height - y])
    out = np.zeros((height, width, samples), kind)
    for i, block in enumerate(blocks):
        plane, k = divmod(i, columns * rows)
        y, x = k // columns * down, k % columns * across
        part = block[:, : width - x]
        if apart:
            out[y : y + len(part), x : x + across, plane] = part[:, :, 0]
        else:
            out[y : y + len(part), x : x + across] = part
    out = out.astype(out.dtype.newbyteorder("<"), copy=False)
    if bits >= 8 and told in (SIGNED, IEEE):
        return out.view(f"<{'i' if told == SIGNED else 'f'}{bits // 8}")
    return out


def read_pages(data: bytes) -> Iterator[tuple[int, dict, np.ndarray | None, str | None]]:
    """Page number, facts, samples, and None or what is wrong; never raises for bad data."""
    page = -1
    whole = lambda x: x if isinstance(x, int) and 0 <= x < 1 << 31 else None
    try:
        for page, (order, fields) in enumerate(directories(data)):
            facts = {"width": fields.get(WIDTH, (0,))[0], "height": fields.get(HEIGHT, (0,))[0], "bits": fields.get(BITS, (1,))[0], "samples": fields.get(SAMPLES, (1,))[0], "compression": fields.get(COMPRESSION, (1,))[0], "predictor": fields.get(PREDICTOR, (1,))[0], "sample_format": fields.get(FORMAT, (UNSIGNED,))[0], "fill_order": fields.get(FILL_ORDER, (1,))[0]}
            facts = {name: whole(value) for name, value in facts.items()} | {"byte_order": "II" if order == "<" else "MM"}
            try:
                yield page, facts, decode_page(data, order, fields), None
            except (TiffError, struct.error, MemoryError) as e:
                yield page, facts, None, str(e)
    except (TiffError, struct.error, MemoryError) as e:
        yield page + 1, {}, None, str(e)


def feature(samples: np.ndarray) -> str:
    """Size, mean in thousandths, and a 64-bit average hash of the page's first sample over an 8 x 8 grid. Of floating-point samples those that aren't finite
    count as 0."""
    flat = samples[:, :, 0]
    kind = np.int64
    if flat.dtype.kind == "f":
        flat, kind = np.where(np.isfinite(flat), flat, 0).astype(float), float
    elif flat.dtype.itemsize == 8:
        kind = float  # sums of these leave 64 bits
    h, w = flat.shape
    rows, cols = np.arange(8) * h // 8, np.arange(8) * w // 8
    sums = np.add.reduceat(np.add.reduceat(flat, rows, axis=0, dtype=kind), cols, axis=1)
    area = np.outer(np.maximum(np.diff(np.append(rows, h)), 1), np.maximum(np.diff(np.append(cols, w)), 1))
    total = flat.sum(dtype=kind)
    total = int(total) if kind is np.int64 else float(total)
    bits = sums * (h * w) > total * area
    mean = total * 1000 // (h * w)
    return f"{w}x{h}x{samples.shape[2]}:{int(mean) if np.isfinite(mean) else 0}:{np.packbits(bits).tobytes().hex()}"


PAGE_SCHEMA = "page int, width long, height long, bits int, samples int, compression int, predictor int, sample_format int, fill_order int, byte_order string, pixels binary, feature string, error string"


def decode_pages(media: DataFrame, key: str, column: str) -> DataFrame:
    """One row for every page of the TIFF files in `column`: the key, then PAGE_SCHEMA; pixels are the samples row by row, the lowest byte of each first
    whatever the file's byte_order, and sample_format tells what they are (1 unsigned, 2 signed, 3 floating point, 4 undefined).

    A null file gives no row. What can't be decoded, an empty file too, gives a row with `error` and null pixels: one for the page, or one
    for the rest of a file whose directories are broken; sizes that don't fit 31 bits are null. A page may have up to LARGEST bytes. Null
    keys and repeated rows give their pages like others; an empty table gives no rows; other columns are ignored, whatever their names.
    """
    kind = media.schema[key].dataType.simpleString()
    names = ["page", "width", "height", "bits", "samples", "compression", "predictor", "sample_format", "fill_order", "byte_order", "pixels", "feature", "error"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.string(), pa.binary(), pa.string(), pa.string()]
        for batch in chunks(batches, "media_", 8_000_000):
            keys, rows = [], [[] for _ in names]
            for i, data in enumerate(batch.column(1)):
                if not data.is_valid:
                    continue
                for page, facts, samples, error in read_pages(data.as_py()):
                    keys.append(i)
                    values = [page, *(facts.get(n) for n in names[1:10]), None if samples is None else samples.tobytes(), None if samples is None else feature(samples), error]
                    for column_values, v in zip(rows, values, strict=True):
                        column_values.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *(pa.array(r, t) for r, t in zip(rows, types, strict=True))], ["key_", *names])

    out = media.select(F.col(key).alias("key_"), F.col(column).alias("media_")).mapInArrow(decode, f"key_ {kind}, {PAGE_SCHEMA}")
    return out.withColumnRenamed("key_", key)


# -- writing


def write_page(pixels: bytes, width: int, code: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = 128) -> bytes:
    """A TIFF file with one page of 8-bit grey samples. tile: width and height, multiples of 16."""
    image = np.frombuffer(pixels, np.uint8).reshape(-1, width)
    height = len(image)
    if tile:
        blocks = []
        for y in range(0, height, tile[1]):
            for x in range(0, width, tile[0]):
                block = np.zeros((tile[1], tile[0]), np.uint8)
                part = image[y : y + tile[1], x : x + tile[0]]
                block[: part.shape[0], : part.shape[1]] = part
                blocks.append(block)
    else:
        blocks = [image[y : y + strip_rows] for y in range(0, height, strip_rows)]
    if predictor == 2:
        blocks = [np.diff(b, axis=1, prepend=np.uint8(0)) for b in blocks]
    stored = [ENCODERS[code](b.tobytes()) for b in blocks]
    sizes = [len(s) for s in stored]
    body = b"".join(stored)
    body += b"\0" * (len(body) % 2)
    at = (8 + np.cumsum([0, *sizes[:-1]])).tolist()
    fields = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8]), (COMPRESSION, [code]), (PHOTOMETRIC, [1]), (SAMPLES, [1]), (PREDICTOR, [predictor])]
    fields += [(TILE_WIDTH, [tile[0]]), (TILE_HEIGHT, [tile[1]]), (TILE_AT, at), (TILE_BYTES, sizes)] if tile else [(STRIP_AT, at), (STRIP_ROWS, [strip_rows]), (STRIP_BYTES, sizes)]
    fields.sort()
    head = 8 + len(body)
    extra_at = head + 2 + 12 * len(fields) + 4
    entries, extra = b"", b""
    for tag, values in fields:
        packed = struct.pack(f"<{len(values)}I", *values)
        if len(values) == 1:
            entries += struct.pack("<HHI", tag, 4, 1) + packed
        else:
            entries += struct.pack("<HHII", tag, 4, len(values), extra_at + len(extra))
            extra += packed
    return struct.pack("<2sHI", b"II", 42, head) + body + struct.pack("<H", len(fields)) + entries + struct.pack("<I", 0) + extra


PAGE_WIDTH = 64


TILE = (64, 64)
#: Every compression with and without differencing, in strips and in tiles.
FORMS = [(code, predictor, tile) for code in (LZW, PACKBITS, DEFLATE, PLAIN) for predictor in (NONE, HORIZONTAL) for tile in (None, TILE)]


def stored_as(payload: bytes) -> bytes:
    """The payload as a page of 64 columns. A hash of the payload chooses one of FORMS, so equal payloads are equal files and every form meets texts of every length."""
    code, predictor, tile = FORMS[zlib.crc32(payload) % len(FORMS)]
    return write_page(payload, PAGE_WIDTH, code, predictor, tile)


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_bytes of the text as UTF-8 (null: empty), media: a TIFF file of these bytes and zeros up to a positive
    multiple of 64. Empty and very long texts are stored whole; null keys and repeated rows give rows like others; other columns are ignored."""
    kind = docs.schema[key].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text_", 8_000_000):
            raw = [(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in batch.column(1)]
            media = [stored_as(r.ljust(max(64, -(-len(r) // 64) * 64), b"\0")) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(media, pa.binary())], ["key_", "n_bytes", "media"])

    return docs.select(F.col(key).alias("key_"), F.col(text).alias("text_")).mapInArrow(store, f"key_ {kind}, n_bytes long, media binary").withColumnRenamed("key_", key)


def op1_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as TIFF and read back: the contract's columns from the read bytes."""
    stored = encode_texts(table(spark, sf_dir, "documents"))
    facts = stored.select(F.struct("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("of"), "media")
    pages = decode_pages(facts, "of", "media")
    return pages.select(
        "of.doc_id", "of.n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, length(pixels) - 63, 64)")).alias("tail_crc32"),
        "of.media_bytes", "of.media_sha256", "feature",
    )
