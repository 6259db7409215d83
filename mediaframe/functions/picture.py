"""Operations on one picture: planes are arrays [rows, pixels, bytes of a pixel]."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np

from mediaframe.functions import colour
from mediaframe.functions.kernels import CHROMA_PLACES, ONE_H, ONE_V, TABLE_KERNELS, float_taps, tap_table
from mediaframe.functions.pixfmt import PixelFormat, pixel_format
from mediaframe.functions.rational import Rational, reduce


@dataclass(frozen=True)
class Video:
    """What is known of a video stream before any frame is read: the type of its frames."""

    pix_fmt: str
    width: int
    height: int
    time_base: Rational = Rational(1, 25)
    frame_rate: Rational = Rational(25, 1)
    sar: Rational = Rational(1, 1)
    color_range: str = "unspecified"
    color_space: str = "unspecified"
    chroma_loc: str = "unspecified"

    @property
    def format(self) -> PixelFormat:
        return pixel_format(self.pix_fmt)

    def with_(self, **changes) -> Video:
        return replace(self, **changes)


Planes = list[np.ndarray]


def split(data: list[bytes], video: Video) -> Planes:
    """Planes from their bytes, without padding."""
    f, out = video.format, []
    for p, raw in enumerate(data):
        step, _ = f.steps()[p]
        rows, line = f.rows(video.height, p), f.line_bytes(video.width, p)
        a = np.frombuffer(raw, np.uint8)
        if a.size != rows * line:
            raise ValueError(f"plane {p} has {a.size} bytes, expected {rows * line} for {video.pix_fmt} {video.width}x{video.height}")
        out.append(a.reshape(rows, line // step, step))
    return out


def hflip_allowed(f: PixelFormat) -> bool:
    return f.chroma[0] == f.chroma[1] or f.components[0][0] != f.components[1][0]


def transpose_allowed(f: PixelFormat) -> bool:
    return f.chroma[0] == f.chroma[1]


def hflip(planes: Planes) -> Planes:
    return [p[:, ::-1] for p in planes]


def vflip(planes: Planes) -> Planes:
    return [p[::-1] for p in planes]


def transpose(planes: Planes, direction: int) -> Planes:
    """0: and flipped vertically; 1: clockwise; 2: counter-clockwise; 3: clockwise and flipped vertically."""
    out = []
    for p in planes:
        t = p.swapaxes(0, 1)
        t = t[:, ::-1] if direction & 1 else t
        out.append(t[::-1] if direction & 2 else t)
    return out


def crop(planes: Planes, f: PixelFormat, x: int, y: int, width: int, height: int) -> Planes:
    """A window whose place is given in luma pixels."""
    out = []
    for i, p in enumerate(planes):
        step, component = f.steps()[i]
        sx = f.chroma[0] if component in (1, 2) else 0
        sy = f.chroma[1] if i in (1, 2) else 0
        x0, y0 = x >> sx, y >> sy
        w, h = -(-width >> sx), -(-height >> sy)
        out.append(p[y0 : y0 + h, x0 : x0 + w])
    return out


def scale_plane_table(plane: np.ndarray, width: int, height: int, kernel: str, place: tuple[int, int] = (128, 128)) -> np.ndarray:
    """One 8-bit plane by integer taps: 15-bit lines, then columns."""
    h, w = plane.shape
    lines = np.minimum(tap_table(kernel, w, width, ONE_H, place[0], 128).apply(plane) >> 7, 32767)
    total = tap_table(kernel, h, height, ONE_V, place[1], 128).apply(lines.T).T
    return np.clip((total + (64 << 12)) >> 19, 0, 255).astype(np.uint8)


def sample(plane: np.ndarray, taps_x: tuple, taps_y: tuple) -> np.ndarray:
    """Separable weighted sums in single precision, terms added in order."""
    (px, wx), (py, wy) = taps_x, taps_y
    rows = np.zeros((plane.shape[0], len(px)), np.float32)
    for i in range(px.shape[1]):
        rows = rows + plane[:, px[:, i]].astype(np.float32) * wx[:, i]
    out = np.zeros((len(py), len(px)), np.float32)
    for j in range(py.shape[1]):
        out = out + rows[py[:, j]] * wy[:, j, None]
    return out


RGB_OUTPUTS = ("rgb24", "bgr24", "rgba", "bgra", "argb", "abgr")
INPUTS = ("yuv420p", "gray")


def conversion(source: str, target: str) -> str:
    """The kind of a scale: 'same' planes or to 'rgb'; other pairs are not supported."""
    if source in INPUTS and target == source:
        return "same"
    if source in INPUTS and target in RGB_OUTPUTS:
        return "rgb"
    raise ValueError(f"conversion {source} to {target} is not supported")


def packed(r: np.ndarray, g: np.ndarray, b: np.ndarray, target: str) -> Planes:
    """One plane of packed RGB; an alpha byte stays 0."""
    f = pixel_format(target)
    out = np.zeros((*r.shape, f.components[0][1]), np.uint8)
    for value, (_, _, offset, *_rest) in zip((r, g, b), f.components):
        out[..., offset] = value
    return [out]


def scale(planes: Planes, source: Video, target: Video, kernel: str = "bicubic") -> Planes:
    """Resize and convert; source and target give sizes and formats, the source also range and chroma location."""
    kind = conversion(source.pix_fmt, target.pix_fmt)
    w, h = target.width, target.height
    same_size = (w, h) == (source.width, source.height)
    if kind == "same" and same_size:
        return planes
    full, gray = source.color_range in ("pc", "jpeg", "full"), source.pix_fmt == "gray"
    flat = [p[..., 0] for p in planes]
    half = lambda v: -(-v // 2)
    if kind == "rgb" and not gray and (same_size or kernel in TABLE_KERNELS):
        if not same_size:
            flat = [p[..., 0] for p in scale(planes, source, target.with_(pix_fmt="yuv420p"), kernel)]
        big = lambda p: p.repeat(2, axis=0)[:h].repeat(2, axis=1)[:, :w]
        return packed(*colour.rgb(flat[0], big(flat[1]), big(flat[2]), full), target.pix_fmt)
    if kernel in TABLE_KERNELS:
        place = CHROMA_PLACES[source.chroma_loc]
        sizes = [(w, h), (half(w), half(h)), (half(w), half(h))]
        out = [scale_plane_table(p, *size, kernel, (128, 128) if i == 0 else place) for i, (p, size) in enumerate(zip(flat, sizes))]
        if kind == "rgb":
            grey = colour.to_byte(colour.expand(out[0], full))
            return packed(grey, grey, grey, target.pix_fmt)
        return [p[..., None] for p in out]
    center = source.chroma_loc == "center"
    taps = lambda n, m, shift=0.0: float_taps(kernel, n, m, shift)
    luma = sample(flat[0], taps(source.width, w), taps(source.height, h))
    if kind == "same":
        out = [colour.to_byte(luma)]
        for p in flat[1:]:
            shift = -0.25 if center else 0.0
            out.append(colour.to_byte(sample(p, taps(p.shape[1], half(w), shift), taps(p.shape[0], half(h), shift))))
        return [p[..., None] for p in out]
    if gray:
        f = colour.expand(luma, full)
        grey = colour.to_byte(f)
        return packed(grey, grey, grey, target.pix_fmt)
    f32 = np.float32
    at = lambda n, m: (np.arange(m, dtype=f32) + f32(0.5)) * f32(n) / f32(m) - f32(0.5)
    chroma = lambda a: (a - f32(0.5)) / f32(2) if center else a / f32(2)
    tx = float_taps(kernel, flat[1].shape[1], w, positions=chroma(at(source.width, w)))
    ty = float_taps(kernel, flat[1].shape[0], h, positions=chroma(at(source.height, h)))
    return packed(*colour.rgb(luma, sample(flat[1], tx, ty), sample(flat[2], tx, ty), full), target.pix_fmt)


def scaled_sar(source: Video, width: int, height: int, reset: bool = False) -> Rational:
    if reset:
        return Rational(1, 1)
    if not source.sar.num or not source.sar.den:
        return source.sar
    return reduce(source.width * height * source.sar.num, source.height * width * source.sar.den)[0]
