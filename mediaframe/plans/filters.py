"""The filters: how their options are read, what formats they take, what they make of a stream's type and of a frame."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from mediaframe.errors import MediaError
from mediaframe.functions import exprlang, picture
from mediaframe.functions.kernels import ALIASES as KERNEL_ALIASES, KERNELS
from mediaframe.functions.picture import Planes, Video
from mediaframe.functions.pixfmt import ALIASES, FORMATS, pixel_format
from mediaframe.functions.rational import Rational, reduce, rescale
from mediaframe.plans.language import parse_options, split_list

#: What a frame function gets besides the planes: n, t (seconds or NaN) and the results it keeps for the next frame.
Apply = Callable[[Planes, float, float], Planes]


class FilterError(MediaError):
    pass


@dataclass
class Bound:
    """A filter with its options read. `accepts` and `makes`: formats it takes and can give (None: any, the same as taken)."""

    name: str
    accepts: Callable[[str], bool] = lambda f: True
    #: Of a converter: the formats that it can make of a taken one.
    makes: Callable[[str], list[str]] | None = None
    #: The type and the frame function for a type; converters also get the format to make.
    configure: Callable[..., tuple[Video, Apply]] = lambda v: (v, lambda p, n, t: p)
    #: Only constrains: its effect is the conversion before it.
    restricts: bool = False


@dataclass(frozen=True)
class FilterDef:
    name: str
    shorthand: tuple[str, ...]
    options: dict[str, str | None]
    bind: Callable[[dict[str, str | None]], Bound]


def _truth(text: str | None) -> bool:
    if str(text).lower() in ("1", "true", "yes", "y", "on", "enable", "enabled"):
        return True
    if str(text).lower() in ("0", "false", "no", "n", "off", "disable", "disabled", "none"):
        return False
    raise FilterError(f"{text!r} is not a truth value")


def _lrint(x: float) -> int:
    return round(x)


CROP_NAMES = {"in_w", "iw", "in_h", "ih", "out_w", "ow", "out_h", "oh", "a", "sar", "dar", "hsub", "vsub", "x", "y", "n", "t"}
SCALE_NAMES = (CROP_NAMES - {"x", "y"}) | {"ohsub", "ovsub"}


def _values(v: Video) -> dict[str, float]:
    sar = float(v.sar) if v.sar.num and v.sar.den else 1.0
    cw, ch = v.format.chroma
    a = v.width / v.height
    return {"in_w": v.width, "iw": v.width, "in_h": v.height, "ih": v.height, "a": a, "sar": sar, "dar": a * sar, "hsub": 1 << cw, "vsub": 1 << ch, "out_w": math.nan, "ow": math.nan, "out_h": math.nan, "oh": math.nan, "x": math.nan, "y": math.nan, "n": 0.0, "t": math.nan}


def bind_crop(o: dict) -> Bound:
    keep_aspect, exact = _truth(o["keep_aspect"]), _truth(o["exact"])
    nodes = {k: exprlang.parse(str(o[k]), CROP_NAMES) for k in ("out_w", "out_h", "x", "y")}

    def configure(v: Video) -> tuple[Video, Apply]:
        values = _values(v)

        def whole(key: str) -> float:
            return exprlang.evaluate(nodes[key], values)

        for key, short in (("out_w", "ow"), ("out_h", "oh"), ("out_w", "ow")):
            values[key] = values[short] = whole(key)
        if math.isnan(values["out_w"]) or math.isnan(values["out_h"]):
            raise FilterError("the size of the crop is not a number")
        w, h = _lrint(values["out_w"]), _lrint(values["out_h"])
        cw, ch = v.format.chroma
        if not exact:
            w, h = w & ~((1 << cw) - 1), h & ~((1 << ch) - 1)
        if w <= 0 or h <= 0 or w > v.width or h > v.height:
            raise FilterError(f"invalid too big or non positive size for width '{w}' or height '{h}'")
        sar = v.sar
        if keep_aspect and v.sar.num:
            dar = reduce(v.width * v.sar.num, v.height * v.sar.den)[0]
            sar = reduce(dar.num * h, dar.den * w)[0]
        values |= {"out_w": float(w), "ow": float(w), "out_h": float(h), "oh": float(h)}
        last = {"x": (v.width - w) / 2, "y": (v.height - h) / 2}

        def place(n: float, t: float) -> tuple[int, int]:
            now = values | {"n": n, "t": t, **last}
            for key in ("x", "y", "x"):
                now[key] = exprlang.evaluate(nodes[key], now)
            out = []
            for key, most, sub in (("x", v.width - w, cw), ("y", v.height - h, ch)):
                value = now[key]
                value = last[key] if math.isnan(value) else value
                at = min(max(_lrint(min(max(value, -1.0), most + 1.0)), 0), most)
                out.append(at if exact else at & ~((1 << sub) - 1))
            return out[0], out[1]

        return v.with_(width=w, height=h, sar=sar), lambda p, n, t: picture.crop(p, v.format, *place(n, t), w, h)

    return Bound("crop", configure=configure)


def bind_transpose(o: dict) -> Bound:
    names = {"cclock_flip": 0, "clock": 1, "cclock": 2, "clock_flip": 3}
    direction = names[str(o["dir"])] if str(o["dir"]) in names else int(str(o["dir"]))
    if not 0 <= direction <= 7:
        raise FilterError(f"dir {direction} is out of range")
    through = {"none": None, "0": None, "portrait": "portrait", "2": "portrait", "landscape": "landscape", "1": "landscape"}.get(str(o["passthrough"]), "bad")
    if through == "bad":
        raise FilterError(f"unknown passthrough {o['passthrough']!r}")
    if direction & 4:
        direction, through = direction & 3, "landscape"

    def configure(v: Video) -> tuple[Video, Apply]:
        if (through == "landscape" and v.width >= v.height) or (through == "portrait" and v.width <= v.height):
            return v, lambda p, n, t: p
        sar = v.sar.inverse() if v.sar.num else v.sar
        return v.with_(width=v.height, height=v.width, sar=sar), lambda p, n, t: picture.transpose(p, direction)

    return Bound("transpose", accepts=lambda f: picture.transpose_allowed(pixel_format(f)), configure=configure)


def bind_format(negate: bool) -> Callable[[dict], Bound]:
    def bind(o: dict) -> Bound:
        wanted = []
        for name in split_list(str(o["pix_fmts"] or "")):
            name = {"rgb32": "bgra", "bgr32": "rgba"}.get(name, ALIASES.get(name, name))
            if name not in FORMATS and f"{name}le" in FORMATS:
                name += "le"
            wanted.append(pixel_format(name).name)
        ranges = split_list(str(o["color_ranges"] or ""))
        spaces = split_list(str(o["color_spaces"] or ""))
        if not wanted and not ranges and not spaces:
            raise FilterError("format needs at least one list")
        allowed = set(FORMATS) if not wanted else (set(FORMATS) - set(wanted) if negate else set(wanted))

        def configure(v: Video) -> tuple[Video, Apply]:
            if ranges and v.color_range != "unspecified" and ((v.color_range in ranges) == negate):
                raise FilterError(f"color range {v.color_range} does not fit {ranges}")
            if spaces and v.color_space != "unspecified" and ((v.color_space in spaces) == negate):
                raise FilterError(f"color space {v.color_space} does not fit {spaces}")
            return v, lambda p, n, t: p

        return Bound("noformat" if negate else "format", accepts=lambda f: f in allowed, configure=configure, restricts=True)

    return bind


def bind_scale(o: dict) -> Bound:
    w, h = o["w"], o["h"]
    if w is not None and h is None:
        o["size"], w = w, None
    if o["size"] is not None:
        if w is not None or h is not None:
            raise FilterError("size and width/height expressions cannot be set at the same time")
        m = str(o["size"]).lower().split("x")
        if len(m) != 2 or not all(x.isdigit() for x in m):
            raise FilterError(f"invalid size {o['size']!r}")
        w, h = m
    w, h = w or "iw", h or "ih"
    names = [KERNEL_ALIASES.get(x, x) for x in str(o["flags"] or "bicubic").split("+") if x]
    kernel = next((x for x in names if x in KERNELS), None)
    if kernel is None:
        raise FilterError(f"unknown scaling flags {o['flags']!r}")
    node_w, node_h = exprlang.parse(str(w), SCALE_NAMES), exprlang.parse(str(h), SCALE_NAMES)
    if node_w.names() & {"out_w", "ow"} or node_h.names() & {"out_h", "oh"}:
        raise FilterError("a size cannot refer to itself")
    if node_w.names() & {"out_h", "oh"} and node_h.names() & {"out_w", "ow"}:
        raise FilterError("circular expressions for width and height")
    if str(o["eval"]) not in ("init", "frame", "0", "1"):
        raise FilterError(f"unknown eval {o['eval']!r}")
    if (node_w.names() | node_h.names()) & {"n", "t"}:
        raise FilterError("expressions with n or t need frames of changing size, which a stream of one type cannot have")
    keep = {"disable": None, "0": None, "decrease": "decrease", "1": "decrease", "increase": "increase", "2": "increase"}[str(o["force_original_aspect_ratio"])]
    divisible, reset = int(str(o["force_divisible_by"])), _truth(o["reset_sar"])

    def size(v: Video, target: str) -> tuple[int, int]:
        values = _values(v)
        cw, ch = pixel_format(target).chroma
        values |= {"ohsub": 1 << cw, "ovsub": 1 << ch}
        for key, short, node in (("out_w", "ow", node_w), ("out_h", "oh", node_h), ("out_w", "ow", node_w)):
            got = exprlang.evaluate(node, values)
            base = v.width if key == "out_w" else v.height
            values[key] = values[short] = float(int(got)) if math.isfinite(got) and int(got) else (got if math.isnan(got) else float(base))
        if math.isnan(values["out_w"]) or math.isnan(values["out_h"]):
            raise FilterError("the size is not a number")
        return adjust(v, int(values["out_w"]), int(values["out_h"]), keep, divisible)

    def configure(v: Video, target: str) -> tuple[Video, Apply]:
        tw, th = size(v, target)
        if tw <= 0 or th <= 0:
            raise FilterError(f"size {tw}x{th} is invalid")
        source = v.with_(**{k: x for k, x in (("color_range", o["in_range"]), ("chroma_loc", o["in_chroma_loc"])) if x is not None})
        out = v.with_(pix_fmt=target, width=tw, height=th, sar=picture.scaled_sar(v, tw, th, reset))
        if (target, tw, th) == (v.pix_fmt, v.width, v.height):
            return out, lambda p, n, t: p
        picture.conversion(v.pix_fmt, target)
        return out, lambda p, n, t: picture.scale(p, source, out, kernel)

    makes = lambda f: [f, *picture.RGB_OUTPUTS] if f in picture.INPUTS else [f]
    return Bound("scale", makes=makes, configure=configure)


def adjust(v: Video, w: int, h: int, keep: str | None, divisible: int) -> tuple[int, int]:
    """Negative sizes follow the other one by the aspect, -n to a multiple of n; then an enforced aspect."""
    fw, fh = (-w if w < -1 else 1), (-h if h < -1 else 1)
    if w < 0 and h < 0:
        w, h = v.width, v.height
    if w < 0:
        w = (rescale(h, v.width, v.height * fw) or 0) * fw
    if h < 0:
        h = (rescale(w, v.height, v.width * fh) or 0) * fh
    if keep:
        tw, th = rescale(h, v.width, v.height) or 0, rescale(w, v.height, v.width) or 0
        w, h = (min(tw, w), min(th, h)) if keep == "decrease" else (max(tw, w), max(th, h))
        if divisible > 1:
            round_ = (lambda x: x // divisible * divisible) if keep == "decrease" else (lambda x: -(-x // divisible) * divisible)
            w, h = round_(w), round_(h)
    return w, h


def _same(name: str, function: Callable[[Planes], Planes], accepts: Callable[[str], bool] = lambda f: True) -> Callable[[dict], Bound]:
    return lambda o: Bound(name, accepts=accepts, configure=lambda v: (v, lambda p, n, t: function(p)))


REGISTRY: dict[str, FilterDef] = {}


def register(d: FilterDef) -> None:
    REGISTRY[d.name] = d


for _d in (
    FilterDef("null", (), {}, _same("null", lambda p: p)),
    FilterDef("copy", (), {}, _same("copy", lambda p: p)),
    FilterDef("hflip", (), {}, _same("hflip", picture.hflip, lambda f: picture.hflip_allowed(pixel_format(f)))),
    FilterDef("vflip", (), {}, _same("vflip", picture.vflip)),
    FilterDef("transpose", ("dir", "passthrough"), {"dir": "0", "passthrough": "none"}, bind_transpose),
    FilterDef("crop", ("out_w", "out_h", "x", "y", "keep_aspect", "exact"), {"out_w": "iw", "out_h": "ih", "x": "(in_w-out_w)/2", "y": "(in_h-out_h)/2", "keep_aspect": "0", "exact": "0"}, bind_crop),
    FilterDef("scale", ("w", "h", "flags"), {"w": None, "h": None, "flags": None, "size": None, "in_range": None, "in_chroma_loc": None, "force_original_aspect_ratio": "0", "force_divisible_by": "1", "reset_sar": "0", "eval": "init"}, bind_scale),
    FilterDef("format", ("pix_fmts",), {"pix_fmts": None, "color_spaces": None, "color_ranges": None}, bind_format(False)),
    FilterDef("noformat", ("pix_fmts",), {"pix_fmts": None, "color_spaces": None, "color_ranges": None}, bind_format(True)),
):
    register(_d)

SYNONYMS = {"w": "out_w", "h": "out_h", "width": "w", "height": "h", "s": "size"}


def bind(name: str, options: str | None, flags: str | None = None) -> Bound:
    d = REGISTRY.get(name)
    if d is None:
        raise FilterError(f"No such filter: '{name}'")
    values = dict(d.options)
    for key, value in parse_options(options, d.shorthand):
        if key not in values:
            key = SYNONYMS.get(key, key)
        if key not in values:
            raise FilterError(f"No such option: {key} in filter {name}")
        values[key] = value
    if name == "scale" and values["flags"] is None:
        values["flags"] = flags
    return d.bind(values)
