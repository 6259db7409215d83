"""Container formats over bytes: headers, records and writers of Y4M, raw video and WAV; scans of MPEG audio and ADTS."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, replace

from mediaframe.errors import MediaError
from mediaframe.functions.layouts import Layout
from mediaframe.functions.picture import Video
from mediaframe.functions.rational import Rational, reduce


class ContainerError(MediaError):
    pass


# Y4M

# Colour-space names by prefix, longest names first where one begins another; None is known but not supported.
Y4M_SPACES = (
    ("420jpeg", ("yuv420p", "center")),
    ("420mpeg2", ("yuv420p", "left")),
    ("420paldv", ("yuv420p", "topleft")),
    ("420p16", ("yuv420p16le", "unspecified")),
    ("422p16", None),
    ("444p16", ("yuv444p16le", "unspecified")),
    ("420p14", None),
    ("422p14", None),
    ("444p14", None),
    ("420p12", None),
    ("422p12", None),
    ("444p12", None),
    ("420p10", ("yuv420p10le", "unspecified")),
    ("422p10", ("yuv422p10le", "unspecified")),
    ("444p10", ("yuv444p10le", "unspecified")),
    ("420p9", None),
    ("422p9", None),
    ("444p9", None),
    ("420", ("yuv420p", "center")),
    ("411", None),
    ("422", ("yuv422p", "unspecified")),
    ("444alpha", None),
    ("444", ("yuv444p", "unspecified")),
    ("mono16", None),
    ("mono12", None),
    ("mono10", None),
    ("mono9", None),
    ("mono", ("gray", "unspecified")),
)
# Tokens that are written.
Y4M_TOKENS = {
    "gray": " Cmono", "yuv420p": " C420jpeg XYSCSS=420JPEG", "yuv422p": " C422 XYSCSS=422", "yuv444p": " C444 XYSCSS=444",
    "yuv420p10le": " C420p10 XYSCSS=420P10", "yuv422p10le": " C422p10 XYSCSS=422P10", "yuv444p10le": " C444p10 XYSCSS=444P10",
    "yuv420p16le": " C420p16 XYSCSS=420P16", "yuv444p16le": " C444p16 XYSCSS=444P16",
}
MAGIC = b"YUV4MPEG2"


def y4m_header(data: bytes) -> tuple[Video, int]:
    """The stream's type, and where its first frame begins."""
    end = data[:128].find(b"\n")
    if not data.startswith(MAGIC) or end < 0:
        raise ContainerError("not a YUV4MPEG2 stream")
    width = height = 0
    rate, sar, space, colour_range = Rational(25, 1), Rational(0, 1), ("yuv420p", "center"), "unspecified"
    for token in data[len(MAGIC) : end].decode("latin-1").split():
        tag, value = token[0], token[1:]
        if tag == "W":
            width = int(value)
        elif tag == "H":
            height = int(value)
        elif tag == "C":
            found = next((s for name, s in Y4M_SPACES if value.startswith(name)), None)
            if found is None:
                raise ContainerError(f"unknown pixel format {value!r}")
            space = found
        elif tag == "I" and value[:1] == "m":
            raise ContainerError("mixed interlaced streams are not supported")
        elif tag in "FA":
            n, _, d = value.partition(":")
            q = Rational(int(n), int(d or 1))
            if tag == "F":
                rate = q if q.num > 0 and q.den > 0 else Rational(25, 1)
            else:
                sar = q
        elif tag == "X" and value.startswith("COLORRANGE="):
            colour_range = {"FULL": "pc", "LIMITED": "tv"}.get(value[11:], "unspecified")
    if width <= 0 or height <= 0:
        raise ContainerError("a YUV4MPEG2 stream needs a width and a height")
    rate = reduce(rate.num, rate.den)[0]
    return Video(space[0], width, height, rate.inverse(), rate, sar, colour_range, chroma_loc=space[1]), end + 1


def y4m_frames(data: bytes) -> Iterator[tuple[int, bytes]]:
    """(number, payload) of each whole frame; frame lines may have parameters."""
    video, at = y4m_header(data)
    size, n = video.format.frame_bytes(video.width, video.height), 0
    while at < len(data):
        end = data.find(b"\n", at, at + 80)
        if not data.startswith(b"FRAME", at) or end < 0:
            raise ContainerError(f"frame {n} has no frame line")
        if end + 1 + size > len(data):
            raise ContainerError(f"frame {n} is cut off")
        yield n, data[end + 1 : end + 1 + size]
        at, n = end + 1 + size, n + 1


def y4m_write_header(video: Video) -> bytes:
    token = Y4M_TOKENS.get(video.pix_fmt, "")
    if video.pix_fmt == "yuv420p":
        token = {"left": " C420mpeg2 XYSCSS=420MPEG2", "topleft": " C420paldv XYSCSS=420PALDV"}.get(video.chroma_loc, token)
    colour = {"pc": " XCOLORRANGE=FULL", "tv": " XCOLORRANGE=LIMITED"}.get(video.color_range, "")
    rate = reduce(video.time_base.den, video.time_base.num)[0]
    sar = Rational(0, 0) if (video.sar.num, video.sar.den) == (0, 1) else video.sar
    return f"YUV4MPEG2 W{video.width} H{video.height} F{rate} Ip A{sar}{token}{colour}\n".encode()


def planes_of(payload: bytes, video: Video) -> list[bytes]:
    out, at = [], 0
    for size in video.format.plane_sizes(video.width, video.height):
        out.append(payload[at : at + size])
        at += size
    return out


def raw_frames(data: bytes, video: Video) -> Iterator[tuple[int, bytes]]:
    """Frames of fixed size; a rest at the end is an error, as it cannot be decoded."""
    size = video.format.frame_bytes(video.width, video.height)
    if len(data) % size:
        raise ContainerError(f"{len(data)} bytes are not a multiple of the frame size {size}")
    for n in range(len(data) // size):
        yield n, data[n * size : (n + 1) * size]


# WAV


@dataclass(frozen=True)
class Audio:
    """What is known of an audio stream before its samples are read."""

    codec: str  # pcm_u8, pcm_s16le, ...
    sample_rate: int
    layout: Layout
    bits: int
    block_align: int

    @property
    def bit_rate(self) -> int:
        return self.sample_rate * self.block_align * 8 if self.block_align == self.layout.count * self.bits // 8 else 0

    @property
    def packet_bytes(self) -> int:
        """About a tenth of a second, as a power of two of sample blocks."""
        blocks = max(1, self.bits * self.sample_rate * self.layout.count // 8 // 10 // self.block_align)
        return self.block_align << (blocks.bit_length() - 1)


#: Format tags.
PCM, FLOAT, ALAW, MULAW, EXTENSIBLE = 1, 3, 6, 7, 0xFFFE
#: Fixed values: (numpy type, bits) of the codecs.
CODECS = {
    "pcm_u8": ("u1", 8), "pcm_s16le": ("<i2", 16), "pcm_s24le": ("<i3", 24), "pcm_s32le": ("<i4", 32), "pcm_f32le": ("<f4", 32), "pcm_f64le": ("<f8", 64),
    "pcm_s16be": (">i2", 16), "pcm_s24be": (">i3", 24), "pcm_s32be": (">i4", 32), "pcm_f32be": (">f4", 32), "pcm_f64be": (">f8", 64),
}
TAIL = bytes.fromhex("000000001000800000aa00389b71")  # fixed value


def wav_codec(tag: int, bits: int) -> str:
    found = {PCM: {8: "pcm_u8", 16: "pcm_s16le", 24: "pcm_s24le", 32: "pcm_s32le"}, FLOAT: {32: "pcm_f32le", 64: "pcm_f64le"}}.get(tag, {}).get(bits)
    if found is None:
        raise ContainerError(f"unsupported WAV format tag {tag:#x} with {bits} bits")
    return found


def wav_header(data: bytes) -> tuple[Audio, int, int]:
    """The type, and where the samples begin and end; an unknown size means up to the end."""
    if data[:4] in (b"RIFX", b"RF64", b"BW64"):
        raise ContainerError(f"{data[:4].decode()} is not supported")
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ContainerError("not a RIFF/WAVE stream")
    at, audio = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        at += 8
        if name == b"fmt " and audio is None:
            audio = _fmt(data[at : at + size])
        elif name == b"data":
            if audio is None:
                raise ContainerError("no fmt chunk before the samples")
            return audio, at, len(data) if size in (0, 0xFFFFFFFF) else min(len(data), at + size)
        at += size + size % 2
    raise ContainerError("no samples in the WAV stream")


def _fmt(body: bytes) -> Audio:
    if len(body) < 14:
        raise ContainerError("the fmt chunk is too short")
    tag, channels, rate, _, block = struct.unpack_from("<HHIIH", body)
    bits = struct.unpack_from("<H", body, 14)[0] if len(body) >= 16 else 8
    mask = 0
    if tag == EXTENSIBLE and len(body) >= 40:
        valid, mask = struct.unpack_from("<HI", body, 18)
        tag = struct.unpack_from("<I", body, 24)[0]
        bits = valid or bits
    layout = Layout.of_mask(mask) if mask and mask.bit_count() == channels else Layout.default(channels)
    return Audio(wav_codec(tag, bits), rate, layout, bits, block or channels * bits // 8)


def wav_write_header(audio: Audio, samples: int) -> bytes:
    """The header of so many bytes of samples."""
    tag = FLOAT if audio.codec.startswith("pcm_f") else PCM
    native = audio.layout.order == "native"
    wide = (native and audio.layout.describe() not in ("mono", "stereo")) or audio.sample_rate > 48000 or (audio.bits > 16 and tag != FLOAT)
    fmt = struct.pack("<HHIIHH", EXTENSIBLE if wide else tag, audio.layout.count, audio.sample_rate, audio.sample_rate * audio.block_align, audio.block_align, audio.bits)
    if wide:
        fmt += struct.pack("<HHI", 22, audio.bits, audio.layout.mask if native else 0) + struct.pack("<H", tag) + TAIL
    elif tag != PCM:
        fmt += struct.pack("<H", 0)
    chunks = b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if tag != PCM:
        chunks += b"fact" + struct.pack("<II", 4, samples // audio.block_align)
    chunks += b"data" + struct.pack("<I", samples)
    return b"RIFF" + struct.pack("<I", 4 + len(chunks) + samples + samples % 2) + b"WAVE" + chunks


# MPEG audio and ADTS

# Bit rates in kbit/s by index, for (lsf, layer), and sample rates.
BIT_RATES = {
    (0, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (0, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (0, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (1, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (1, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (1, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
MPEG_RATES = (44100, 48000, 32000)
ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)


@dataclass(frozen=True)
class MpegHeader:
    layer: int
    lsf: int
    sample_rate: int
    channels: int
    bit_rate: int
    frame_bytes: int
    samples: int


def mpeg_header(word: int) -> MpegHeader | None:
    """The frame that a 32-bit header announces; None if it is none, or of free format."""
    if word & 0xFFE00000 != 0xFFE00000 or word >> 19 & 3 == 1 or not word >> 17 & 3 or word >> 12 & 15 in (0, 15) or word >> 10 & 3 == 3:
        return None
    old, half = not word >> 20 & 1, not word >> 19 & 1
    lsf = 1 if old else int(half)
    layer = 4 - (word >> 17 & 3)
    rate = MPEG_RATES[word >> 10 & 3] >> (lsf + int(old))
    kbits, padding = BIT_RATES[lsf, layer][word >> 12 & 15], word >> 9 & 1
    size = (kbits * 12000 // rate + padding) * 4 if layer == 1 else kbits * 144000 // (rate << (lsf if layer == 3 else 0)) + padding
    return MpegHeader(layer, lsf, rate, 1 if word >> 6 & 3 == 3 else 2, kbits * 1000, size, 384 if layer == 1 else 576 if layer == 3 and lsf else 1152)


def id3_bytes(data: bytes, at: int = 0) -> int:
    """Length of an ID3v2 tag at a place, or 0."""
    b = data[at : at + 10]
    if len(b) < 10 or b[:3] != b"ID3" or b[3] == 0xFF or b[4] == 0xFF or any(x & 0x80 for x in b[6:10]):
        return 0
    return 10 + (b[6] << 21 | b[7] << 14 | b[8] << 7 | b[9]) + (10 if b[5] & 0x10 else 0)


#: Header bits that stay the same within a stream.
SAME = 0xFFE00000 | 3 << 17 | 3 << 10 | 3 << 19


def _first_frame(data: bytes) -> int:
    """The place of the first frame: after tags, the first of two headers that agree."""
    at = 0
    while n := id3_bytes(data, at):
        at += n
    word = lambda p: int.from_bytes(data[p : p + 4], "big")
    for p in range(at, min(len(data) - 4, at + 65536) + 1):
        h = mpeg_header(word(p))
        if h and (p + h.frame_bytes >= len(data) or (mpeg_header(word(p + h.frame_bytes)) and word(p) & SAME == word(p + h.frame_bytes) & SAME)):
            return p
    raise ContainerError("no MPEG audio frames found")


def _information(data: bytes, at: int, h: MpegHeader) -> int:
    """The place of the information in the frame at `at`, or -1."""
    side = at + 4 + (17 if h.channels == 1 else 32 if not h.lsf else 17) - (8 if h.lsf and h.channels == 1 else 0)
    return side if data[side : side + 4] in (b"Xing", b"Info") else at + 36 if data[at + 36 : at + 40] == b"VBRI" else -1


#: Fixed value: samples that a decoder of layer III is late by.
DECODER_DELAY = 529
#: Encoders whose delays are trusted; bytes from the end of the counts to the delays.
ENCODERS, TO_DELAYS = (b"LAME", b"Lavf", b"Lavc"), 21


def mpeg_gapless(data: bytes) -> tuple[int, int, int]:
    """Samples to skip at the start, and between which sample numbers all are to be discarded, from the information frame; zeros if it has none."""
    at = _first_frame(data)
    h = mpeg_header(int.from_bytes(data[at : at + 4], "big"))
    place = _information(data, at, h)
    if place < 0 or data[place : place + 4] == b"VBRI" or len(data) < place + 8:
        return 0, 0, 0
    flags = int.from_bytes(data[place + 4 : place + 8], "big")
    count = int.from_bytes(data[place + 8 : place + 12], "big") if flags & 1 else 0
    place += 8 + sum(size for bit, size in ((1, 4), (2, 4), (4, 100), (8, 4)) if flags & bit)
    if data[place : place + 4] not in ENCODERS or len(data) < place + TO_DELAYS + 3:
        return 0, 0, 0
    both = int.from_bytes(data[place + TO_DELAYS : place + TO_DELAYS + 3], "big")
    end = count * h.samples
    return (both >> 12) + DECODER_DELAY, end - (both & 4095) + DECODER_DELAY if count else 0, end


def mpeg_frames(data: bytes) -> Iterator[tuple[int, int, MpegHeader]]:
    """(place, pts in samples, header) of each audio frame; a leading information frame is passed over."""
    at = _first_frame(data)
    word = lambda p: int.from_bytes(data[p : p + 4], "big")
    pts, first = 0, True
    while at + 4 <= len(data):
        h = mpeg_header(word(at))
        if h is None or at + h.frame_bytes > len(data):
            if n := id3_bytes(data, at):
                at += n
                continue
            if data[at : at + 3] == b"TAG":
                return
            at += 1
            continue
        information, first = first and _information(data, at, h) >= 0, False
        if not information:
            yield at, pts, h
            pts += h.samples
        at += h.frame_bytes


@dataclass(frozen=True)
class AdtsHeader:
    object_type: int
    sample_rate: int
    channels: int
    frame_bytes: int
    samples: int
    crc: bool


def adts_header(b: bytes) -> AdtsHeader | None:
    if len(b) < 7 or b[0] != 0xFF or b[1] & 0xF6 != 0xF0:
        return None
    index, size = b[2] >> 2 & 15, (b[3] & 3) << 11 | b[4] << 3 | b[5] >> 5
    if index >= len(ADTS_RATES) or size < 7:
        return None
    channels = (b[2] & 1) << 2 | b[3] >> 6
    return AdtsHeader((b[2] >> 6) + 1, ADTS_RATES[index], 8 if channels == 7 else channels, size, 1024 * ((b[6] & 3) + 1), not b[1] & 1)


def adts_frames(data: bytes) -> Iterator[tuple[int, int, AdtsHeader]]:
    at = pts = 0
    while at + 7 <= len(data):
        if n := id3_bytes(data, at):
            at += n
            continue
        h = adts_header(data[at : at + 7])
        if h is None or at + h.frame_bytes > len(data):
            at += 1
            continue
        yield at, pts, h
        at, pts = at + h.frame_bytes, pts + h.samples


# Choice of a format

EXTENSIONS = {"y4m": "y4m", "yuv": "rawvideo", "rgb": "rawvideo", "wav": "wav", "mp3": "mp3", "aac": "aac", "h264": "h264", "264": "h264", "avc": "h264"}
PROBE_BYTES, ENOUGH = 2048, 50


def _runs(sizes: list[int | None]) -> list[tuple[int, int]]:
    """Frames from each place on, and their bytes, given each place's frame size."""
    out = [(0, 0)] * len(sizes)
    for at in range(len(sizes) - 1, -1, -1):
        if size := sizes[at]:
            n, length = out[at + size] if at + size < len(sizes) else (0, 0)
            out[at] = n + 1, length + size
    return out


def probe(data: bytes) -> dict[str, int]:
    """Scores from 0 to 100 by format."""
    data = data[:PROBE_BYTES]
    scores = {"y4m": 100 * data.startswith(MAGIC), "wav": 99 * (data[:4] == b"RIFF" and data[8:12] == b"WAVE")}
    # a start code, and a sequence set or what may stand before it: a delimiter, information
    scores["h264"] = 60 * bool(re.match(rb"\x00{2,3}\x01[\x06\x09\x27\x47\x67]", data) and re.search(rb"\x00\x00\x01[\x27\x47\x67]", data))
    skip = 0
    while n := id3_bytes(data, skip):
        skip += n
    end = max(0, len(data) - 4)
    sizes = [h.frame_bytes if (h := mpeg_header(int.from_bytes(data[p : p + 4], "big"))) else None for p in range(end)]
    found = _runs(sizes)[min(skip, end) :] or [(0, 0)]
    most = max(n for n, _ in found)
    longest = max(length for _, length in found)
    half, tenth = len(data) < 2 * longest, len(data) < 10 * longest  # how much of what is looked at is frames
    scores["mp3"] = 52 if found[0][0] >= 7 else 50 if most > 200 and half else 25 if most >= 4 and half else 13 if id3_bytes(data) else 1 if most >= 1 and tenth else 0
    end = max(0, len(data) - 7)
    sizes = [h.frame_bytes if (h := adts_header(data[p : p + 7])) else None for p in range(end)]
    runs = [n for n, _ in _runs(sizes)] or [0]
    scores["aac"] = 51 if runs[0] >= 3 else 50 if max(runs) > 100 else 25 if max(runs) >= 3 else 1 if runs[0] else 0
    return scores


def pick(path: str, head: bytes, given: str | None = None) -> str:
    """The given format, or that of the extension, or the best of the probe if it is sure enough."""
    if given:
        if given not in set(EXTENSIONS.values()):
            raise ContainerError(f"unknown format {given!r}")
        return given
    extension = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if extension in EXTENSIONS:
        return EXTENSIONS[extension]
    best, score = max(probe(head).items(), key=lambda x: x[1])
    if score <= ENOUGH:
        raise ContainerError("invalid data found: no format fits")
    return best


def with_rate(video: Video, rate: Rational) -> Video:
    return replace(video, frame_rate=rate, time_base=rate.inverse())
