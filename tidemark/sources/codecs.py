"""GeoTIFF, PNG and shapefile bytes, in numpy and the standard library."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

#: TIFF field types: struct letter and size; sample formats. Fixed values.
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
_KINDS = {1: "u", 2: "i", 3: "f"}
#: Tags used here. Fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIE, MATRIX, GEO_KEYS = 322, 323, 324, 325, 339, 33550, 33922, 34264, 34735
GEOGRAPHIC, PROJECTED, NODATA = 2048, 3072, 42113


@dataclass
class Raster:
    """bands: (band, row, col); transform: (a, b, c, d, e, f); epsg 0: none."""

    bands: np.ndarray
    transform: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    epsg: int = 0
    nodata: float | None = None
    tags: dict[int, tuple] = field(default_factory=dict)


def _fields(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    tags: dict[int, tuple] = {}
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = at + 2 + 12 * k
        tag, kind, n = struct.unpack(order + "HHI", data[entry : entry + 8])
        if kind not in _TYPES:
            continue
        letter, size = _TYPES[kind]
        start = entry + 8 if n * size <= 4 else struct.unpack(order + "I", data[entry + 8 : entry + 12])[0]
        raw = data[start : start + n * size]
        tags[tag] = (raw.rstrip(b"\0"),) if kind == 2 else struct.unpack(order + letter * n, raw)
    return order, tags


def _inflate(raw: bytes, compression: int) -> bytes:
    if compression == 1:
        return raw
    if compression in (8, 32946):
        return zlib.decompress(raw)
    raise ValueError(f"TIFF compression {compression} is not supported")


def read_tiff(data: bytes, bands: Sequence[int] | None = None, header_only: bool = False) -> Raster:
    """bands: from 1; None: all."""
    order, t = _fields(data)
    one = lambda tag, other=None: t[tag][0] if tag in t else other
    height, width, samples = one(HEIGHT), one(WIDTH), one(SAMPLES, 1)
    transform = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    if MATRIX in t:
        m = t[MATRIX]
        transform = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif SCALE in t and TIE in t:
        i, j, _, x, y, _ = t[TIE][:6]
        sx, sy = t[SCALE][:2]
        transform = (sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    keys = t.get(GEO_KEYS, ())
    held = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
    epsg = held.get(PROJECTED) or held.get(GEOGRAPHIC) or 0
    nodata = float(t[NODATA][0]) if NODATA in t and t[NODATA][0] else None
    wanted = list(range(1, samples + 1)) if bands is None else list(bands)
    dtype = np.dtype(f"{order}{_KINDS[one(FORMAT, 1)]}{one(BITS, 8) // 8}")
    if header_only:
        return Raster(np.empty((len(wanted), height, 0), dtype.newbyteorder("=")), transform, epsg, nodata, t)
    planar, tiled = one(PLANAR, 1) == 2, TILES in t
    th, tw = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    offsets, sizes = (t[TILES], t[TILE_SIZES]) if tiled else (t[STRIPS], t[STRIP_SIZES])
    across, down = -(-width // tw), -(-height // th)
    out = np.zeros((samples, height, width), dtype.newbyteorder("="))
    for plane in range(samples if planar else 1):
        if planar and plane + 1 not in wanted:
            continue
        for k in range(across * down):
            raw = _inflate(data[offsets[plane * across * down + k] :][: sizes[plane * across * down + k]], one(COMPRESSION, 1))
            own = 1 if planar else samples
            rows = th if tiled else min(th, height - k // across * th)
            block = np.frombuffer(raw, dtype, rows * tw * own).reshape(rows, tw, own)
            if one(PREDICTOR, 1) == 2:
                block = np.cumsum(block, axis=1, dtype=dtype)
            r, c = k // across * th, k % across * tw
            part = block[: height - r, : width - c].transpose(2, 0, 1)
            out[plane : plane + 1 if planar else samples, r : r + part.shape[1], c : c + part.shape[2]] = part
    return Raster(out[[b - 1 for b in wanted]], transform, epsg, nodata, t)


def write_tiff(raster: Raster, deflate: bool = True) -> bytes:
    """Little-endian strips, planes apart."""
    bands = np.ascontiguousarray(raster.bands)
    samples, height, width = bands.shape
    kind = {"u": 1, "i": 2, "f": 3}[bands.dtype.kind]
    rows = max(1, min(height, (1 << 16) // max(1, width * bands.itemsize)))
    strips = [band[r : r + rows].astype(bands.dtype.newbyteorder("<")).tobytes() for band in bands for r in range(0, height, rows)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    a, b, c, d, e, f = map(float, raster.transform)
    tags: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (bands.itemsize * 8,) * samples), (COMPRESSION, 3, (8 if deflate else 1,)), (PHOTOMETRIC, 3, (1,)),
        (STRIPS, 4, ()), (SAMPLES, 3, (samples,)), (STRIP_ROWS, 4, (rows,)), (STRIP_SIZES, 4, tuple(map(len, strips))), (PLANAR, 3, (2,)), (FORMAT, 3, (kind,) * samples),
        (MATRIX, 12, (a, b, 0.0, c, d, e, 0.0, f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)),
    ]
    if raster.epsg:
        geographic = 4000 <= raster.epsg < 5000
        tags.append((GEO_KEYS, 3, (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, raster.epsg)))
    if raster.nodata is not None:
        tags.append((NODATA, 2, tuple(f"{raster.nodata:g}\0".encode())))
    tags.sort()
    at = 8 + 2 + 12 * len(tags) + 4
    sizes = {tag: (len(strips) if tag == STRIPS else len(v)) * _TYPES[k][1] for tag, k, v in tags}
    extra = sum(n + n % 2 for n in sizes.values() if n > 4)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in strips])[:-1]]).astype(int) + at + extra
    head, tail = struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)), b""
    for tag, k, values in tags:
        values = tuple(int(s) for s in starts) if tag == STRIPS else values
        letter = "B" if k == 2 else _TYPES[k][0]
        raw = struct.pack("<" + letter * len(values), *values)
        if len(raw) <= 4:
            head += struct.pack("<HHI", tag, k, len(values)) + raw.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, k, len(values), at + len(tail))
            tail += raw + b"\0" * (len(raw) % 2)
    return head + struct.pack("<I", 0) + tail + b"".join(strips)


_PNG = b"\x89PNG\r\n\x1a\n"


def write_png(image: np.ndarray) -> bytes:
    """8-bit grey (h, w) or RGB (h, w, 3)."""
    h, w = image.shape[:2]
    rows = np.zeros((h, 1 + image[0].size), np.uint8)
    rows[:, 1:] = image.reshape(h, -1)
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if image.ndim == 3 else 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """8-bit grey, RGB, RGBA or palette (as RGB) without interlacing."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG file")
    at, body, head, colours = 8, b"", b"", None
    while at < len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            head = part
        elif name == b"PLTE":
            colours = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body += part
        at += 12 + n
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", head)
    if depth != 8 or interlaced:
        raise ValueError("only 8-bit PNG without interlacing")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h, w * n), np.uint8)
    zero = np.zeros(w * n, np.uint8)
    for y in range(h):
        how, line, up = rows[y, 0], rows[y, 1:].astype(np.int32), (out[y - 1] if y else zero).astype(np.int32)
        if how == 0:
            out[y] = line
        elif how == 1:
            out[y] = (np.cumsum(line.reshape(w, n), 0) & 255).reshape(-1)
        elif how == 2:
            out[y] = (line + up) & 255
        else:
            now = np.zeros(w * n + n, np.int32)
            for x in range(w * n):
                a, b, c = now[x], up[x], up[x - n] if x >= n else 0
                if how == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                now[x + n] = (line[x] + guess) & 255
            out[y] = now[n:]
    image = out.reshape(h, w, n)
    return colours[image[..., 0]] if kind == 3 else image[..., 0] if n == 1 else image


# Shapefiles: polylines (shape type 3) with integer, float and text attributes.


def write_shapefile(lines: Sequence[Sequence[tuple[float, float]]], records: Sequence[dict], epsg: int = 0) -> dict[str, bytes]:
    """Bytes of .shp, .shx, .dbf and .prj by suffix. Field names are cut to ten characters."""
    shapes, index, at = [], [], 50
    boxes = []
    for k, line in enumerate(lines, 1):
        xy = np.array(line, "<f8").reshape(-1, 2)
        box = (*xy.min(0), *xy.max(0))
        boxes.append(box)
        body = struct.pack("<i4dii", 3, *box, 1, len(xy)) + struct.pack("<i", 0) + xy.tobytes()
        shapes.append(struct.pack(">ii", k, len(body) // 2) + body)
        index.append(struct.pack(">ii", at, len(body) // 2))
        at += 4 + len(body) // 2
    b = np.array(boxes or [(0.0,) * 4])
    bounds = (*b[:, :2].min(0), *b[:, 2:].max(0), 0.0, 0.0, 0.0, 0.0)
    header = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<ii8d", 1000, 3, *bounds)
    names = list(records[0]) if records else []
    fields, rows = b"", [b" "] * len(records)
    for name in names:
        values = [r[name] for r in records]
        if all(isinstance(v, (int, np.integer)) or v is None for v in values):
            kind, places, texts = b"N", 0, ["" if v is None else str(v) for v in values]
        elif all(isinstance(v, (int, float, np.floating)) or v is None for v in values):
            kind, places, texts = b"F", 11, ["" if v is None else f"{v:.11e}" for v in values]
        else:
            kind, places, texts = b"C", 0, ["" if v is None else str(v) for v in values]
        raw = [x.encode()[:254] for x in texts]
        size = max([1, *map(len, raw)])
        fields += name.encode()[:10].ljust(11, b"\0") + kind + b"\0" * 4 + struct.pack("<BB", size, places) + b"\0" * 14
        rows = [row + (x.ljust(size) if kind == b"C" else x.rjust(size)) for row, x in zip(rows, raw, strict=True)]
    width = len(rows[0]) if rows else 1 + sum(fields[32 * k + 16] for k in range(len(names)))
    dbf = struct.pack("<BBBBIHH20x", 3, 100, 1, 1, len(records), 32 + len(fields) + 1, width) + fields + b"\r" + b"".join(rows) + b"\x1a"
    out = {".shp": header(at) + b"".join(shapes), ".shx": header(50 + 4 * len(index)) + b"".join(index), ".dbf": dbf}
    return out | ({".prj": projection_text(epsg).encode()} if epsg else {})


def read_shapefile(shp: bytes, dbf: bytes) -> tuple[list[list[tuple[float, float]]], list[dict]]:
    """(lines, records); the parts of a multi-part line follow one another."""
    lines, at = [], 100
    while at < len(shp):
        n = struct.unpack(">i", shp[at + 4 : at + 8])[0]
        body = shp[at + 8 : at + 8 + 2 * n]
        kind = struct.unpack("<i", body[:4])[0]
        if kind not in (0, 3, 5):
            raise ValueError(f"shape type {kind} is not supported")
        if kind:
            parts, points = struct.unpack("<ii", body[36:44])
            lines.append([tuple(p) for p in np.frombuffer(body, "<f8", 2 * points, 44 + 4 * parts).reshape(-1, 2).tolist()])
        else:
            lines.append([])
        at += 8 + 2 * n
    count, head, size = struct.unpack("<IHH", dbf[4:12])
    fields = [(dbf[k : k + 11].split(b"\0")[0].decode(), dbf[k + 11 : k + 12], dbf[k + 16], dbf[k + 17]) for k in range(32, head - 1, 32)]
    records = []
    for r in range(count):
        p, row = head + r * size + 1, {}
        for name, kind, width, places in fields:
            raw = dbf[p : p + width].decode().strip()
            p += width
            row[name] = raw if kind == b"C" else None if not raw else float(raw) if kind == b"F" or places else int(raw)
        records.append(row)
    return lines, records


def projection_text(epsg: int) -> str:
    """Well-known text of the systems that are supported."""
    from tidemark.functions.crs import NORTH, SOUTH, meridian, northing, zone_of

    zone = zone_of(epsg)
    wgs = epsg == 4326 or any(1 <= epsg - first <= n for first, n in (NORTH, SOUTH))
    datum = ("WGS_1984", "WGS_1984", 298.257223563) if wgs else ("North_American_1983", "GRS_1980", 298.257222101)
    geographic = f'GEOGCS["GCS_{datum[0]}",DATUM["D_{datum[0]}",SPHEROID["{datum[1]}",6378137.0,{datum[2]}]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433],AUTHORITY["EPSG","{epsg}"]]'
    if zone is None:
        return geographic
    values = {"False_Easting": 500000.0, "False_Northing": northing(zone), "Central_Meridian": meridian(zone), "Scale_Factor": 0.9996, "Latitude_Of_Origin": 0.0}
    inner = geographic.replace(f',AUTHORITY["EPSG","{epsg}"]', "")
    return f'PROJCS["UTM_Zone_{abs(zone)}{'S' if zone < 0 else 'N'}",{inner},PROJECTION["Transverse_Mercator"],{",".join(f"""PARAMETER["{k}",{v}]""" for k, v in values.items())},UNIT["Meter",1.0],AUTHORITY["EPSG","{epsg}"]]'


def epsg_of(text: str) -> int:
    """The code at the end of a projection text, 0 if it has none."""
    import re

    found = re.findall(r'AUTHORITY\["EPSG","(\d+)"\]', text)
    return int(found[-1]) if found else 0
