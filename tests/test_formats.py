from mediaframe.functions.picture import Video
from mediaframe.functions.pixfmt import FORMATS, fitness, padded_bits, pixel_format
from mediaframe.plans.graph import plan


def test_fitness():
    f = pixel_format
    assert all(fitness(x, x) == 0 for x in FORMATS.values())
    better = lambda source, a, b: fitness(f(a), f(source)) > fitness(f(b), f(source))
    assert better("yuv420p", "yuv422p", "gray") and better("yuv420p10le", "yuv420p16le", "yuv420p")
    assert better("rgba", "bgra", "rgb24") and better("yuv444p", "yuv422p", "rgb24") and better("gray", "rgb24", "yuv420p") is not None
    assert (padded_bits(f("rgb565le")), padded_bits(f("yuv420p")), padded_bits(f("rgba")), padded_bits(f("nv12"))) == (16, 12, 32, 12)


def test_choice():
    v = Video("yuv420p", 16, 16)
    assert plan("format=rgba|rgb24|bgr24", v).target.pix_fmt == "rgb24"
    assert plan("format=bgra|argb", v).target.pix_fmt == "bgra"
    assert plan("format=gray|rgb24|yuv420p", v).target.pix_fmt == "yuv420p"
    assert plan("noformat=yuv420p|gray,null", v).target.pix_fmt == "rgb24"
    assert plan("scale=8:8,format=bgr24,hflip", v).describe().endswith("-> Parsed_hflip_2: bgr24 8x8")


def test_errors_and_levels():
    import logging

    import pytest

    from mediaframe.errors import MediaError, log, set_level
    from mediaframe.functions.exprlang import parse as expression
    from mediaframe.plans.language import parse

    for bad in (lambda: parse(""), lambda: expression("1+", set()), lambda: plan("nope", Video("gray", 2, 2))):
        with pytest.raises(MediaError):
            bad()
    wanted = {"quiet": logging.CRITICAL + 1, "error": logging.ERROR, "warning": logging.WARNING, "info": logging.INFO, "trace": logging.DEBUG}
    for name, level in wanted.items():
        set_level(name)
        assert log.level == level, name
