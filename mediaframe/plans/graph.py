"""From the syntax tree to a plan: filters are bound, put in line, their formats negotiated (with conversions inserted where
neighbours disagree) and their types worked out, all on the driver; the plan then runs as one pass over the frames."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mediaframe.functions.picture import Video, split
from mediaframe.functions.pixfmt import fitness, padded_bits, pixel_format
from mediaframe.functions.rational import Rational
from mediaframe.plans import filters
from mediaframe.plans.filters import Apply, Bound, FilterError
from mediaframe.plans.language import FilterCall, Graph, parse, parse_options
from mediaframe.session import map_arrow


@dataclass(frozen=True)
class Step:
    """A configured filter: its name as in the plan, its type before and after, and its work on a frame."""

    name: str
    before: Video
    after: Video
    apply: Apply


@dataclass(frozen=True)
class VideoPlan:
    steps: tuple[Step, ...]
    source: Video

    @property
    def target(self) -> Video:
        return self.steps[-1].after if self.steps else self.source

    def describe(self) -> str:
        show = lambda v: f"{v.pix_fmt} {v.width}x{v.height}"
        return "\n".join([show(self.source), *(f"-> {s.name}: {show(s.after)}" for s in self.steps)])


def in_line(graph: Graph) -> list[FilterCall]:
    """The filters in the order that the frames take; every pad must be linked, 'in' and 'out' being the ends."""
    calls = [list(c) for c in graph.chains]
    for c in calls:
        for i, call in enumerate(c):
            if len(call.inputs) > 1 or len(call.outputs) > 1:
                raise FilterError(f"filter {call.name!r} has one input and one output")
            if i and call.inputs or i < len(c) - 1 and call.outputs:
                raise FilterError(f"filter {call.name!r} is linked twice")
    starts = [c for c in calls if not c[0].inputs or c[0].inputs == ("in",)]
    if len(starts) != 1:
        raise FilterError("the graph needs exactly one open input")
    left = [c for c in calls if c is not starts[0]]
    out, now = [], starts[0]
    while True:
        out += now
        label = now[-1].outputs[0] if now[-1].outputs else "out"
        if label == "out":
            break
        after = [c for c in left if c[0].inputs == (label,)]
        if len(after) != 1:
            raise FilterError(f"label {label!r} is not linked once")
        left = [c for c in left if c is not after[0]]
        now = after[0]
    if left:
        raise FilterError(f"filter {left[0][0].name!r} is not linked")
    return out


def _choose(now: str, possible: list[str], allowed: list, order: list[str]) -> str:
    fit = [f for f in possible if all(a(f) for a in allowed)]
    if not fit:
        raise FilterError(f"impossible to convert {now} to what the following filters take")
    if now in fit:
        return now
    source = pixel_format(now)

    def rank(name: str) -> tuple:
        """Least loss, then fewest bits in memory, then fewest components, then the order of the lists."""
        f = pixel_format(name)
        return -fitness(f, source, source.alpha), padded_bits(f), len(f.components), order.index(name) if name in order else len(order)

    return min(fit, key=rank)


def plan(text: str, source: Video, sink: list[str] | None = None) -> VideoPlan:
    """The plan of a filter text over frames of a type; `sink`: formats that the reader of the result takes."""
    graph = parse(text)
    order: list[str] = list(sink or [])
    bound: list[tuple[str, Bound]] = []
    for i, call in enumerate(in_line(graph)):
        bound.append((call.instance or f"Parsed_{call.name}_{i}", filters.bind(call.name, call.options, graph.scale_flags)))
        order += [p for p in (call.options or "").replace("pix_fmts=", "").split(":")[0].split("|") if call.name == "format"]
    if sink:
        bound.append(("sink", Bound("format", accepts=lambda f: f in sink, restricts=True)))
    steps: list[Step] = []
    video, inserted = source, 0
    for i, (name, b) in enumerate(bound):
        following = []
        for _, later in bound[i + 1 :]:
            if later.makes:
                break
            following.append(later.accepts)
        if b.makes:
            after, apply = b.configure(video, _choose(video.pix_fmt, b.makes(video.pix_fmt), following, order))
        else:
            if not b.accepts(video.pix_fmt):
                convert = filters.bind("scale", None, graph.scale_flags)
                wanted = _choose(video.pix_fmt, convert.makes(video.pix_fmt), [b.accepts, *following], order)
                after, apply = convert.configure(video, wanted)
                steps.append(Step(f"auto_scale_{inserted}", video, after, apply))
                video, inserted = after, inserted + 1
            after, apply = b.configure(video)
        if not b.restricts:
            steps.append(Step(name, video, after, apply))
        video = after
    return VideoPlan(tuple(steps), source)


FRAME = "stream_id long, n long, pts long, duration long, planes array<binary>"


def run(frames: DataFrame, p: VideoPlan) -> DataFrame:
    """The plan over FRAME rows (stream_id, n, pts, duration, planes); one narrow pass, also in Structured Streaming."""
    base = float(p.source.time_base)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, pts = batch.column("n").to_pylist(), batch.column("pts").to_pylist()
            done = []
            for i, data in enumerate(batch.column("planes")):
                planes = split([x.as_buffer().to_pybytes() for x in data.values], p.source)
                t = np.nan if pts[i] is None else pts[i] * base
                for s in p.steps:
                    planes = s.apply(planes, float(n[i]), t)
                done.append([np.ascontiguousarray(x).tobytes() for x in planes])
            columns = [pa.array(done, pa.list_(pa.binary())) if c == "planes" else batch.column(c) for c in ("stream_id", "n", "pts", "duration", "planes")]
            yield pa.RecordBatch.from_arrays(columns, ["stream_id", "n", "pts", "duration", "planes"])

    return map_arrow(frames.select("stream_id", "n", "pts", "duration", "planes"), work, FRAME)


def filter_video(frames: DataFrame, source: Video, text: str, sink: list[str] | None = None) -> tuple[DataFrame, Video]:
    """The frames after the filters, and their type."""
    p = plan(text, source, sink)
    return (run(frames, p) if p.steps else frames), p.target


#: Options of a graph's source: names, in the order in which values without a name are taken.
SOURCE_OPTIONS = ("width", "height", "pix_fmt", "time_base", "sar")


def source_of(text: str) -> Video:
    """The type that a source's options tell, such as `video_size=64x48:pix_fmt=yuv420p:time_base=1/25:frame_rate=25/1`.

    Size, format and time base are required; the last of an option that is given twice counts.
    """
    given: dict[str, object] = {}
    for key, value in parse_options(text, SOURCE_OPTIONS):
        if key == "video_size":
            w, _, h = value.partition("x")
            given |= {"width": _whole(key, w), "height": _whole(key, h)}
        elif key in ("width", "height"):
            given[key] = _whole(key, value)
        elif key == "pix_fmt":
            given[key] = pixel_format(value).name
        elif key in ("time_base", "frame_rate", "sar", "pixel_aspect"):
            given["sar" if key == "pixel_aspect" else key] = _ratio(key, value)
        elif key in ("colorspace", "range"):
            given[{"colorspace": "color_space", "range": "color_range"}[key]] = value
        else:
            raise FilterError(f"a source has no option {key!r}")
    if missing := [k for k in ("width", "height", "pix_fmt", "time_base") if k not in given]:
        raise FilterError(f"a source needs {', '.join(missing)}")
    given.setdefault("frame_rate", Rational(0, 1))
    given.setdefault("sar", Rational(0, 1))
    return Video(**given)


def source_text(video: Video) -> str:
    """The options that tell a type: source_of() of it is the type."""
    q = lambda r: f"{r.num}/{r.den}"
    return f"video_size={video.width}x{video.height}:pix_fmt={video.pix_fmt}:time_base={q(video.time_base)}:frame_rate={q(video.frame_rate)}:sar={q(video.sar)}:colorspace={video.color_space}:range={video.color_range}"


def _whole(key: str, text: str) -> int:
    if not text.strip().isdigit() or not int(text):
        raise FilterError(f"{key} is no positive number: {text!r}")
    return int(text)


def _ratio(key: str, text: str) -> Rational:
    num, _, den = text.replace(":", "/").partition("/")
    try:
        return Rational(int(num), int(den or 1))
    except ValueError:
        raise FilterError(f"{key} is no ratio: {text!r}") from None
