"""Measures of images and their bytes, as numpy kernels for Arrow UDFs."""

from __future__ import annotations

import struct

import numpy as np

# The standard luminance quantisation table, row by row, and names of editors that leave a mark.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
EDITORS = ["photoshop", "gimp", "lightroom", "affinity", "pixlr", "snapseed", "picsart", "canva", "paint.net", "coreldraw"]


def zigzag(n: int = 8) -> list[int]:
    """Places of an n x n block in the order of its diagonals."""
    return [r * n + c for r, c in sorted(((r, c) for r in range(n) for c in range(n)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))]


ZIGZAG = np.array(zigzag())


def standard_table(quality: int) -> np.ndarray:
    """The luminance table that common encoders use at a quality from 1 to 100."""
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(LUMINANCE) * scale + 50) // 100, 1, 255)


def segments(raw: bytes) -> list[tuple[int, bytes]]:
    """(marker, body) of the segments of JPEG bytes up to the scan; empty for anything else."""
    if raw[:2] != b"\xff\xd8":
        return []
    out, at = [], 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker = raw[at + 1]
        size = struct.unpack(">H", raw[at + 2 : at + 4])[0]
        if marker == 0xDA or size < 2 or at + 2 + size > len(raw):
            break
        out.append((marker, raw[at + 4 : at + 2 + size]))
        at += 2 + size
    return out


def software(raw: bytes) -> str | None:
    """The software tag (0x0131) of the first EXIF segment."""
    for marker, body in segments(raw):
        if marker == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
            if not order or len(tiff) < 8:
                return None
            at = struct.unpack(order + "I", tiff[4:8])[0]
            if at + 2 > len(tiff):
                return None
            for k in range(struct.unpack(order + "H", tiff[at : at + 2])[0]):
                entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
                if len(entry) < 12:
                    return None
                tag, kind, count = struct.unpack(order + "HHI", entry[:8])
                if tag == 0x0131 and kind == 2:
                    where = struct.unpack(order + "I", entry[8:])[0]
                    text = entry[8 : 8 + count] if count <= 4 else tiff[where : where + count]
                    return text.rstrip(b"\0").decode("ascii", "replace").strip() or None
    return None


def exif_verdict(raw: bytes | None) -> str:
    if not raw:
        return "inconclusive"
    tag = software(raw)
    return "not_applicable" if tag is None else "fail" if any(e in tag.lower() for e in EDITORS) else "pass"


def tables(raw: bytes) -> list[np.ndarray]:
    """8-bit quantisation tables in reading order."""
    out = []
    for marker, body in segments(raw):
        while marker == 0xDB and body:
            wide = body[0] >> 4
            size = 128 if wide else 64
            values = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8)
            if len(values) == 64:
                table = np.zeros(64, int)
                table[ZIGZAG] = values
                out.append(table)
            body = body[1 + size :]
    return out


def jpeg_verdict(raw: bytes | None) -> tuple[str, int]:
    """(verdict, nearest quality): whether the first table is a standard one at some quality."""
    found = tables(raw or b"")
    if not found:
        return "not_applicable", 0
    gaps = [int(np.abs(found[0] - standard_table(q)).sum()) for q in range(1, 101)]
    best = int(np.argmin(gaps))
    return ("pass" if gaps[best] == 0 else "fail"), best + 1


def laplacian_variance(plane: np.ndarray) -> float:
    """Variance of the 4-neighbour Laplacian, edges mirrored without the edge itself."""
    p = np.pad(np.asarray(plane, float), 1, mode="reflect")
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


def block_means(plane: np.ndarray, size: int) -> np.ndarray:
    h, w = plane.shape[0] // size, plane.shape[1] // size
    return plane[: h * size, : w * size].reshape(h, size, w, size).mean((1, 3))


def robust_z(values: np.ndarray) -> np.ndarray:
    middle = np.median(values)
    spread = 1.4826 * np.median(np.abs(values - middle))
    return np.zeros_like(values, float) if spread <= 1e-9 else (values - middle) / spread


def noise_outliers(plane: np.ndarray, size: int = 8, cut: float = 4.5) -> float:
    """Share of blocks whose high-pass energy against their detail stands out."""
    p = np.asarray(plane, float)
    q = np.pad(p, 1, mode="reflect")
    blur = sum(q[i : i + p.shape[0], j : j + p.shape[1]] for i in range(3) for j in range(3)) / 9
    energy, detail = block_means((p - blur) ** 2, size), block_means(np.abs(np.gradient(p)[0]) + np.abs(np.gradient(p)[1]), size)
    return float((np.abs(robust_z((energy / (detail**2 + 1)).ravel())) > cut).mean())


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = np.asarray(a, float).ravel(), np.asarray(b, float).ravel()
    a, b = a - a.mean(), b - b.mean()
    scale = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / scale) if scale > 1e-9 else 0.0


# Fixed values of the print-screen measure: tile edge, least deviation of a tile with print on it, share that fails.
SCREEN_TILE, SCREEN_DETAIL, SCREEN_SHARE = 128, 4.0, 0.28


def screen_period(tile: np.ndarray) -> float | None:
    """Distance from the origin of a tile's strongest spatial frequency; None for a tile without detail."""
    p = np.asarray(tile, float)
    p = p - p.mean()
    if p.std() < SCREEN_DETAIL:
        return None
    fade = np.hanning(len(p))
    power = np.abs(np.fft.fft2(p * np.outer(fade, fade)))
    power[0, 0] = 0
    y, x = np.unravel_index(power.argmax(), power.shape)
    return float(np.hypot(min(y, len(p) - y), min(x, len(p) - x)))


def screen_disagreement(plane: np.ndarray, size: int = SCREEN_TILE) -> tuple[float, int]:
    """(share of tiles whose print screen isn't the page's, tiles measured).

    No tiles count where fewer than two rows or columns fit, or where the tiles' frequencies
    have no middle that most are near; under four, nothing is told of them.
    """
    down, across = plane.shape[0] // size, plane.shape[1] // size
    if min(down, across) < 2:
        return 0.0, 0
    tiles = plane[: down * size, : across * size].reshape(down, size, across, size).swapaxes(1, 2).reshape(-1, size, size)
    found = np.array([f for f in map(screen_period, tiles) if f is not None])
    if len(found) < 4:
        return 0.0, len(found)
    middle = np.median(found)
    off = np.abs(found - middle)
    if middle <= 0 or np.median(off) > 0.5 * middle:
        return 0.0, 0
    return float((off > max(2.0, 0.25 * middle)).mean()), len(found)


def screen_verdict(plane: np.ndarray) -> tuple[str, float]:
    """Verdict and confidence of the print-screen check on a grey plane of at most 1,024 pixels a side."""
    share, tiles = screen_disagreement(plane)
    if tiles < 4:
        return "inconclusive", 0.0
    return ("fail", min(0.9, 0.4 + share)) if share >= SCREEN_SHARE else ("pass", 0.6)


def copied_shift(keypoints: np.ndarray, descriptors: np.ndarray, most: int = 32, bucket: int = 8, least: float = 5.0) -> tuple[int, int, int]:
    """The shift (dx, dy, matches) that most pairs of like descriptors share: each keypoint with its nearest other one."""
    best: dict[tuple[int, int], int] = {}
    for i in range(len(descriptors)):
        gap = np.bitwise_count(descriptors ^ descriptors[i]).sum(1).astype(int)
        gap[i] = 1 << 20
        j = int(gap.argmin())
        d = keypoints[j] - keypoints[i]
        if gap[j] <= most and np.hypot(*d) >= least:
            d = d if tuple(d) > (0, 0) else -d
            key = (int(d[0] // bucket), int(d[1] // bucket))
            best[key] = best.get(key, 0) + 1
    if not best:
        return 0, 0, 0
    (x, y), n = max(best.items(), key=lambda kv: (kv[1], kv[0]))
    return x * bucket, y * bucket, n


def suppress(boxes: np.ndarray, scores: np.ndarray, overlap: float = 0.45) -> list[int]:
    """Greedy non-maximum suppression: indices kept, best first."""
    order, keep = np.argsort(-scores, kind="stable"), []
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    while len(order):
        i, order = int(order[0]), order[1:]
        keep.append(i)
        w = np.minimum(boxes[i, 2], boxes[order, 2]) - np.maximum(boxes[i, 0], boxes[order, 0])
        h = np.minimum(boxes[i, 3], boxes[order, 3]) - np.maximum(boxes[i, 1], boxes[order, 1])
        inter = np.maximum(0, w) * np.maximum(0, h)
        order = order[inter / (area[i] + area[order] - inter + 1e-12) <= overlap]
    return keep


def letterbox(width: int, height: int, side: int) -> tuple[float, float, float]:
    """(scale, left, top) that fit an image into a square."""
    scale = min(side / width, side / height)
    return scale, (side - width * scale) / 2, (side - height * scale) / 2


def decode_head(rows: np.ndarray, width: int, height: int, side: int = 640, least: float = 0.25, overlap: float = 0.45) -> list[tuple[int, float, tuple]]:
    """(class, score, box in pixels) from detector rows (cx, cy, w, h, class scores...)."""
    scale, left, top = letterbox(width, height, side)
    score, cls = rows[:, 4:].max(1), rows[:, 4:].argmax(1)
    own = score >= least
    rows, score, cls = rows[own], score[own], cls[own]
    if not len(rows):
        return []
    xy, half = rows[:, :2], rows[:, 2:4] / 2
    boxes = np.concatenate([xy - half, xy + half], 1)
    boxes = (boxes - [left, top, left, top]) / scale
    boxes = np.clip(boxes, 0, [width, height, width, height])
    return [(int(cls[i]), float(score[i]), tuple(boxes[i].tolist())) for i in suppress(boxes + 4096 * cls[:, None], score, overlap)]


def similarity_transform(src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """2 x 3 matrix of the least-squares similarity from src to dst points."""
    ms, md = src.mean(0), dst.mean(0)
    a, b = src - ms, dst - md
    u, s, vt = np.linalg.svd(b.T @ a / len(src))
    sign = np.diag([1.0, np.sign(np.linalg.det(u @ vt)) or 1.0])
    turn = u @ sign @ vt
    scale = np.trace(np.diag(s) @ sign) / (a**2).sum() * len(src)
    return np.concatenate([scale * turn, (md - scale * turn @ ms)[:, None]], 1)
