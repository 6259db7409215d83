"""Whole conversions: a file in, a file out, as the command line `python -m mediaframe` does them."""

from __future__ import annotations

import argparse
import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediaframe.errors import MediaError
from mediaframe.functions import layouts, samples
from mediaframe.functions.picture import Video
from mediaframe.functions.rational import Rational, display_aspect, from_float, reduce, time_string
from mediaframe.operators import audio as ops
from mediaframe.plans.graph import filter_video
from mediaframe.sources import containers as c, media


class OptionError(MediaError):
    pass


@dataclass(frozen=True)
class Spec:
    source: str
    target: str
    input_format: str | None = None
    output_format: str | None = None
    size: tuple[int, int] | None = None
    pix_fmt: str | None = None
    filters: str | None = None
    sample_rate: int | None = None
    channels: int | None = None
    sample_fmt: str | None = None
    input_size: tuple[int, int] | None = None
    input_pix_fmt: str = "yuv420p"
    framerate: Rational = Rational(25, 1)
    overwrite: bool = False

    @property
    def video_options(self) -> bool:
        return bool(self.size or self.pix_fmt or self.filters)

    @property
    def audio_options(self) -> bool:
        return bool(self.sample_rate or self.channels or self.sample_fmt)


@dataclass(frozen=True)
class Summary:
    frames: int
    bytes: int
    seconds: float
    elapsed: float

    def line(self) -> str:
        rate = self.bytes * 8 / 1000 / self.seconds if self.seconds else 0.0
        return f"frame={self.frames:5d} fps={self.frames / max(self.elapsed, 1e-9):3.1f} size={self.bytes // 1024:8d}KiB time={time_string(self.seconds)} bitrate={rate:6.1f}kbits/s speed={self.seconds / max(self.elapsed, 1e-9):.3g}x"


def parse_size(text: str) -> tuple[int, int]:
    w, _, h = text.lower().partition("x")
    if not (w.isdigit() and h.isdigit() and int(w) and int(h)):
        raise OptionError(f"invalid size {text!r}")
    return int(w), int(h)


def parse_rate(text: str) -> Rational:
    n, sep, d = text.partition(":") if ":" in text else text.partition("/")
    q = reduce(int(n), int(d))[0] if sep else from_float(float(text), 1001000)
    if q.num <= 0 or q.den <= 0:
        raise OptionError(f"invalid frame rate {text!r}")
    return q


def describe_video(v: Video) -> str:
    dar = f" [SAR {v.sar} DAR {display_aspect(v.width, v.height, v.sar)}]" if v.sar.num > 0 else ""
    colour = f"({v.color_range})" if v.color_range != "unspecified" else ""
    return f"Video: rawvideo, {v.pix_fmt}{colour}, {v.width}x{v.height}{dar}, {float(v.frame_rate):.6g} fps"


def describe_audio(a: c.Audio) -> str:
    return f"Audio: {a.codec}, {a.sample_rate} Hz, {a.layout.describe()}, {a.bit_rate // 1000} kb/s"


def transcode(spark: SparkSession, spec: Spec) -> Summary:
    """Convert and write; the kind of the input decides which options it takes."""
    if os.path.exists(spec.target) and not spec.overwrite:
        raise OptionError(f"{spec.target} exists already")
    kind = c.pick(*media.head(spark, spec.source), spec.input_format)
    began = time.time()
    if kind in ("y4m", "rawvideo", "h264"):
        if spec.audio_options:
            raise OptionError("audio options do not apply to a video input")
        frames, seconds, size = _video(spark, spec, kind)
    else:
        if spec.video_options:
            raise OptionError("video options do not apply to an audio input")
        if kind != "wav":
            raise OptionError(f"decoding {kind} is not supported")
        frames, seconds, size = _audio(spark, spec)
    return Summary(frames, size, seconds, time.time() - began)


def _video(spark: SparkSession, spec: Spec, kind: str) -> tuple[int, float, int]:
    df, video = media.read_video(spark, spec.source, kind, spec.input_pix_fmt, spec.input_size, spec.framerate)
    text = ",".join(x for x in (spec.filters or "", f"scale={spec.size[0]}x{spec.size[1]}".replace("scale=", "scale=size=") if spec.size else "", f"format={spec.pix_fmt}" if spec.pix_fmt else "") if x)
    if text:
        df, video = filter_video(df, video, text)
    out = spec.output_format or c.EXTENSIONS.get(spec.target.rsplit(".", 1)[-1].lower(), "rawvideo")
    if out not in ("y4m", "rawvideo"):
        raise OptionError(f"{out} does not hold video")
    size = media.save(media.y4m_bytes(df, video) if out == "y4m" else media.raw_bytes(df), spec.target)
    per = video.format.frame_bytes(video.width, video.height) + (6 if out == "y4m" else 0)
    n = size // per
    return n, n * float(video.time_base), size


def plan_audio(a: c.Audio, spec: Spec) -> tuple[c.Audio, list[str]]:
    """The output's type, and the stages in order: mixing to fewer channels comes before a rate conversion, to more after it."""
    rate = spec.sample_rate or a.sample_rate
    layout = layouts.Layout.default(spec.channels) if spec.channels else a.layout
    codec = {"u8": "pcm_u8", "s16": "pcm_s16le", "s32": "pcm_s32le", "flt": "pcm_f32le", "dbl": "pcm_f64le"}[spec.sample_fmt] if spec.sample_fmt else a.codec
    bits = c.CODECS[codec][1]
    stages = []
    if layout != a.layout:
        stages.append("mix")
    if rate != a.sample_rate:
        first = layout.count * rate > a.layout.count * a.sample_rate and layout != a.layout
        stages = ["resample", *stages] if first else [*stages, "resample"]
    if codec != a.codec or stages:
        stages = ["to_float", *stages, "from_float"] if stages else ["cast"]
    return c.Audio(codec, rate, layout, bits, bits // 8 * layout.count), stages


def sample_format(codec: str) -> str:
    return {"pcm_u8": "u8", "pcm_s16": "s16", "pcm_s24": "s32", "pcm_s32": "s32", "pcm_f32": "flt", "pcm_f64": "dbl"}[codec[:7] if codec != "pcm_u8" else codec]


def convert_audio(pcm: DataFrame, source: c.Audio, target: c.Audio, stages: list[str]) -> DataFrame:
    for s in stages:
        if s in ("to_float", "cast"):
            pcm = ops.cast(pcm, sample_format(source.codec), "dbl" if s == "to_float" else sample_format(target.codec))
        elif s == "mix":
            pcm = ops.mix(pcm, layouts.matrix(source.layout, target.layout))
        elif s == "resample":
            pcm = ops.resample(pcm, source.sample_rate, target.sample_rate)
        else:
            pcm = pcm.withColumn("v", samples.cast(F.col("v"), "dbl", sample_format(target.codec)))
    return pcm


def _audio(spark: SparkSession, spec: Spec) -> tuple[int, float, int]:
    source = media.wav_type(spark, spec.source)
    target, stages = plan_audio(source, spec)
    packets = media.read_packets(spark, spec.source, "wav")
    if stages:
        packets = media.encode_pcm(convert_audio(media.decode_pcm(packets, source), source, target, stages), target)
    packets = packets.select("stream_id", "seq", "data")
    size = media.save(media.wav_bytes(packets, target), spec.target)
    n = max(0, size - 44) // target.block_align
    return n, n / target.sample_rate, size


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="mediaframe", description="Convert a video or audio file.")
    p.add_argument("-i", dest="source", required=True)
    p.add_argument("-f", dest="output_format")
    p.add_argument("-input_format")
    p.add_argument("-video_size", dest="input_size", type=parse_size)
    p.add_argument("-pixel_format", dest="input_pix_fmt", default="yuv420p")
    p.add_argument("-framerate", type=parse_rate, default=Rational(25, 1))
    p.add_argument("-s", dest="size", type=parse_size)
    p.add_argument("-pix_fmt")
    p.add_argument("-vf", dest="filters")
    p.add_argument("-ar", dest="sample_rate", type=int)
    p.add_argument("-ac", dest="channels", type=int)
    p.add_argument("-sample_fmt", choices=("u8", "s16", "s32", "flt", "dbl"))
    p.add_argument("-y", dest="overwrite", action="store_true")
    p.add_argument("target")
    spec = Spec(**vars(p.parse_args(argv)))
    from mediaframe.session import local_session

    print(transcode(SparkSession.getActiveSession() or local_session("mediaframe"), spec).line())
    return 0
