import copy

import pytest

from readtally.config import ConfigError, from_dict
from readtally.functions import patterns

GOOD = {"input": {"bam": "a.bam", "source": {"mode": "bam_references"}}, "dedup": {"mode": "none"}, "output": {"directory": "out"}}


def _with(**changes):
    data = copy.deepcopy(GOOD)
    for path, value in changes.items():
        *parents, last = path.split("__")
        d = data
        for p in parents:
            d = d[p]
        if value is None:
            d.pop(last)
        else:
            d[last] = value
    return data


def test_defaults():
    c = from_dict(GOOD)
    assert (c.max_skip_length, c.correct_clipping, c.strategy.overlap, c.strategy.multi_region, c.strategy.direction) == (150, True, "union", "count_both", "forward")


@pytest.mark.parametrize(
    ("data", "text"),
    [
        (_with(input__source=None), "missing field `source`"),
        (_with(input__bam=""), "BAM filename can not be an empty string"),
        (_with(filter=[{"mode": "reference", "action": "keep", "references": []}]), "Reference filter requires at least one reference to filter on."),
        (_with(input__source={"mode": "bam_tag", "tag": "1X"}), r"BAM tag must start with \[A-Za-z\]"),
        (_with(input__source={"mode": "bam_tag", "tag": "X-"}), r"BAM tag 2nd letter must conform to \[A-Za-z0-9\]"),
        (_with(dedup={"mode": "umi"}), "UMI deduplication quantification requires UMI extraction"),
        (_with(dedup={"mode": "sc"}), "SingleCell quantification requires cell barcodes"),
        (_with(dedup={"mode": "sc"}, cell_barcodes={}), "SingleCell quantification requires UMI extraction"),
        (_with(input__what=1), "unknown field `what`"),
    ],
)
def test_errors(data, text):
    with pytest.raises(ConfigError, match=text):
        from_dict(data)


def test_dedup_ignores_unknown_keys():
    assert from_dict(_with(dedup={"mode": "None", "direction": "x", "bucket": "PerReference"})).dedup_bucket == "per_reference"


@pytest.mark.parametrize(("name", "mode"), [("NInUMI", "n_in_umi"), ("NInUmi", "n_in_umi"), ("n_in_umi", "n_in_umi"), ("PolyXUMI", "polyx_umi"), ("PolyXUmi", "polyx_umi"), ("PolyAUMI", "polya_umi"), ("PolyAUmi", "polya_umi"), ("MultiMapper", "multimapper"), ("multimapper", "multimapper"), ("NonPrimary", "non_primary"), ("Read1", "read1")])
def test_filter_spellings(name, mode):
    assert from_dict(_with(filter=[{"mode": name, "action": "Keep"}])).filters[0]["mode"] == mode


@pytest.mark.parametrize(("name", "mode"), [("NoDedup", "none"), ("none", "none"), ("Umi", "umi"), ("SingleCell", "sc"), ("singlecell", "sc"), ("sc", "sc")])
def test_dedup_spellings(name, mode):
    extract = {"mode": "RegexName", "regex": "umi=([AGCT-]*)"}
    assert from_dict(_with(dedup={"mode": name}, umi=extract, cell_barcodes={"extract": extract, "separator_char": 45})).dedup_mode == mode


@pytest.mark.parametrize(
    ("pattern", "java", "groups"),
    [
        (r"umi=(?P<the_umi>[ACGT-]*)", r"umi=([ACGT-]*)", 1),
        (r"(?<a>x)|(?:y)|(z)", r"(x)|(?:y)|(z)", 2),
        (r"_([^_]+)$", r"_([^_]+)\z", 1),
        (r"(?m)(a)$", r"(?m)(a)$", 1),
        (r"[[:alpha:]]+?[^[:digit:]_]", r"[\p{Alpha}]+?[^\p{Digit}_]", 0),
        (r"[]a][^]b][a&b][a&&[b]]", r"[\]a][^\]b][a\&b][a&&[b]]", 0),
        (r"\v\x41\x{42}\u{43}\pL\P{Lu}\.\d{2,3}?", r"\x0B\x{41}\x{42}\x{43}\p{L}\P{Lu}\.\d{2,3}?", 0),
        (r"(?i)x(?s-i:.)", r"(?i)x(?s-i:.)", 0),
    ],
)
def test_patterns(spark, pattern, java, groups):
    assert patterns.translated(pattern) == ("(?d)" + java, groups)
    spark._jvm.java.util.regex.Pattern.compile("(?d)" + java)


@pytest.mark.parametrize("pattern", [r"(?=a)", r"(?!a)", r"(?<=a)b", r"(?<!a)b", r"(a)\1", r"(?>a)", r"a*+", r"a**", "(", ")", "(a", "*a", "a{,3}", "[a", "\\", r"\Qa\E", r"\Z", r"\h", r"\G", r"[a--b]", r"[a~~b]", r"\p{Greek}", r"\b{start}", r"\<a", "(?U)a", "(?x)a", r"\x{110000}", "(?P<1>a)"])
def test_refused_patterns(pattern):
    """Patterns that the dialects read differently, or that have no counterpart, fail in the configuration."""
    with pytest.raises(ConfigError, match="invalid regex"):
        from_dict(_with(umi={"mode": "RegexName", "regex": pattern}))


def test_command_line(capsys, monkeypatch, tmp_path):
    from readtally import __main__, __version__

    monkeypatch.setattr(__main__.sys, "excepthook", None)
    assert __main__.main(["x.toml", "--version"]) == 0 and capsys.readouterr().out == f"{__version__}\n"
    assert (__main__.main([]), __main__.main(["--help"])) == (1, 0) and "usage" in capsys.readouterr().out
    assert __main__.sys.excepthook is __main__.friendly
    with pytest.raises(RuntimeError, match="friendly panic test"):
        __main__.main(["--test-friendly-panic"])
    monkeypatch.setattr(__main__.tempfile, "tempdir", str(tmp_path))
    __main__.friendly(ValueError, ValueError("odd"), None)
    (report,) = tmp_path.iterdir()
    assert str(report) in capsys.readouterr().err and "odd" in report.read_text()
    (tmp_path / "c.toml").write_text("a = 1\n")
    assert __main__.main([str(tmp_path / "c.toml")]) == 1 and "unknown field `a`" in capsys.readouterr().err
