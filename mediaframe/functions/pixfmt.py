"""Pixel formats: where the components of a pixel lie, and the geometry that follows."""

from __future__ import annotations

from dataclasses import dataclass

# For each component (plane, step, offset, shift, depth), in bytes and bits.
_PLANAR8 = ((0, 1, 0, 0, 8), (1, 1, 0, 0, 8), (2, 1, 0, 0, 8))
_PLANAR10 = ((0, 2, 0, 0, 10), (1, 2, 0, 0, 10), (2, 2, 0, 0, 10))
_PLANAR16 = ((0, 2, 0, 0, 16), (1, 2, 0, 0, 16), (2, 2, 0, 0, 16))


@dataclass(frozen=True)
class PixelFormat:
    """chroma: log2 of the horizontal and vertical subsampling of planes 1 and 2."""

    name: str
    chroma: tuple[int, int]
    components: tuple[tuple[int, int, int, int, int], ...]
    rgb: bool = False
    alpha: bool = False

    @property
    def planes(self) -> int:
        return 1 + max(c[0] for c in self.components)

    @property
    def packed(self) -> bool:
        return self.planes == 1 and len(self.components) > 1

    @property
    def bits(self) -> int:
        """Bits of a pixel, chroma counted by its share."""
        w, h = self.chroma
        area = w + h
        return sum(c[4] << (0 if i in (1, 2) else area) for i, c in enumerate(self.components)) >> area

    def steps(self) -> list[tuple[int, int]]:
        """For each plane: the largest step, and the component that has it."""
        out = [(0, 0)] * self.planes
        for i, (plane, step, *_) in enumerate(self.components):
            if step > out[plane][0]:
                out[plane] = (step, i)
        return out

    def line_bytes(self, width: int, plane: int) -> int:
        step, component = self.steps()[plane]
        shift = self.chroma[0] if component in (1, 2) else 0
        return step * -(-width >> shift)

    def rows(self, height: int, plane: int) -> int:
        return -(-height >> self.chroma[1]) if plane in (1, 2) else height

    def plane_sizes(self, width: int, height: int) -> list[int]:
        if not (0 < width < 1 << 31 and 0 < height < 1 << 31):
            raise ValueError(f"picture size {width}x{height} is invalid")
        return [self.line_bytes(width, p) * self.rows(height, p) for p in range(self.planes)]

    def frame_bytes(self, width: int, height: int) -> int:
        return sum(self.plane_sizes(width, height))


def _packed(*offsets: int) -> tuple:
    step = len(offsets)
    return tuple((0, step, o, 0, 8) for o in offsets)


FORMATS: dict[str, PixelFormat] = {
    f.name: f
    for f in (
        PixelFormat("yuv420p", (1, 1), _PLANAR8),
        PixelFormat("yuv422p", (1, 0), _PLANAR8),
        PixelFormat("yuv444p", (0, 0), _PLANAR8),
        PixelFormat("yuv420p10le", (1, 1), _PLANAR10),
        PixelFormat("yuv422p10le", (1, 0), _PLANAR10),
        PixelFormat("yuv444p10le", (0, 0), _PLANAR10),
        PixelFormat("yuv420p16le", (1, 1), _PLANAR16),
        PixelFormat("yuv444p16le", (0, 0), _PLANAR16),
        PixelFormat("nv12", (1, 1), ((0, 1, 0, 0, 8), (1, 2, 0, 0, 8), (1, 2, 1, 0, 8))),
        PixelFormat("nv21", (1, 1), ((0, 1, 0, 0, 8), (1, 2, 1, 0, 8), (1, 2, 0, 0, 8))),
        PixelFormat("yuyv422", (1, 0), ((0, 2, 0, 0, 8), (0, 4, 1, 0, 8), (0, 4, 3, 0, 8))),
        PixelFormat("uyvy422", (1, 0), ((0, 2, 1, 0, 8), (0, 4, 0, 0, 8), (0, 4, 2, 0, 8))),
        PixelFormat("gray", (0, 0), ((0, 1, 0, 0, 8),)),
        PixelFormat("gray16le", (0, 0), ((0, 2, 0, 0, 16),)),
        PixelFormat("rgb24", (0, 0), _packed(0, 1, 2), rgb=True),
        PixelFormat("bgr24", (0, 0), _packed(2, 1, 0), rgb=True),
        PixelFormat("rgba", (0, 0), _packed(0, 1, 2, 3), rgb=True, alpha=True),
        PixelFormat("bgra", (0, 0), _packed(2, 1, 0, 3), rgb=True, alpha=True),
        PixelFormat("argb", (0, 0), _packed(1, 2, 3, 0), rgb=True, alpha=True),
        PixelFormat("abgr", (0, 0), _packed(3, 2, 1, 0), rgb=True, alpha=True),
        PixelFormat("rgb565le", (0, 0), ((0, 2, 1, 3, 5), (0, 2, 0, 5, 6), (0, 2, 0, 0, 5)), rgb=True),
        PixelFormat("gbrp", (0, 0), ((2, 1, 0, 0, 8), (0, 1, 0, 0, 8), (1, 1, 0, 0, 8)), rgb=True),
        PixelFormat("gbrap", (0, 0), ((2, 1, 0, 0, 8), (0, 1, 0, 0, 8), (1, 1, 0, 0, 8), (3, 1, 0, 0, 8)), rgb=True, alpha=True),
    )
}
# Other names of formats.
ALIASES = {
    "gray8": "gray", "y8": "gray", "y16le": "gray16le", "yuyv422p": "yuyv422", "uyvy422p": "uyvy422", "gbrp8": "gbrp",
    "yuv420p10": "yuv420p10le", "yuv422p10": "yuv422p10le", "yuv444p10": "yuv444p10le", "yuv420p16": "yuv420p16le", "yuv444p16": "yuv444p16le",
}


def pixel_format(name: str) -> PixelFormat:
    found = FORMATS.get(ALIASES.get(name, name))
    if found is None:
        raise ValueError(f"unknown pixel format {name!r}")
    return found


def colour_kind(f: PixelFormat) -> str:
    return "rgb" if f.rgb else "gray" if len(f.components) == 1 else "yuv"


def padded_bits(f: PixelFormat) -> int:
    """Bits of a pixel in memory, with unused ones."""
    w, h = f.chroma
    steps: dict[tuple[int, int], int] = {}
    for i, (plane, step, *_rest) in enumerate(f.components):
        shift = 0 if i in (1, 2) else w + h
        steps[plane, 0] = max(steps.get((plane, 0), 0), step * 8 << shift)
    return sum(steps.values()) >> (w + h)


def fitness(target: PixelFormat, source: PixelFormat, alpha: bool = True) -> int:
    """How well the target keeps what the source has: 0 for the same format, else less, the more is lost.

    Fixed values: what losses of depth, resolution, colour, chroma and alpha cost, and the small preferences besides.
    """
    if target == source:
        return 0
    cost = 1
    pairs = list(zip(source.components, target.components))
    for s, t in pairs:
        cost += 65536 >> (t[4] - 1) if s[4] > t[4] else t[4] - s[4]
    for s, t in zip(source.chroma, target.chroma):
        cost += 256 << t if t > s else 1 << (s - t) if t < s else 0
    if target.chroma == (1, 1) and source.chroma == (0, 0):
        cost -= 512
    kinds = colour_kind(target), colour_kind(source)
    accepted = {"rgb": ("rgb", "gray"), "gray": ("gray",), "yuv": ("yuv",)}[kinds[0]]
    if kinds[1] not in accepted:
        cost += len(pairs) * 65536 >> (min(target.components[0][4], source.components[0][4]) - 1)
    if kinds[0] == "gray" and kinds[1] != "gray":
        cost += 2 * 65536
    if alpha and source.alpha and not target.alpha:
        cost += 65536
    return -cost
