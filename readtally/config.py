"""Configuration of a quantification: dataclasses read from TOML, checked in a fixed order."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from readtally.functions import patterns


class ConfigError(ValueError):
    pass


def _take(section: str, data: dict, known: dict[str, Any], strict: bool = True) -> dict:
    """Values of the known keys (default ... = required); unknown keys are refused if ``strict``."""
    if strict and (extra := sorted(set(data) - set(known))):
        raise ConfigError(f"unknown field `{extra[0]}` in {section}")
    out = {}
    for key, default in known.items():
        if key in data:
            out[key] = data[key]
        elif default is ...:
            raise ConfigError(f"missing field `{key}` in {section}")
        else:
            out[key] = default
    return out


# Spellings of modes besides snake_case and CamelCase.
_SPELLINGS = {
    "NInUMI": "n_in_umi", "NInUmi": "n_in_umi", "PolyXUMI": "polyx_umi", "PolyXUmi": "polyx_umi", "PolyAUMI": "polya_umi", "PolyAUmi": "polya_umi",
    "NoDedup": "none", "MultiMapper": "multimapper", "SingleCell": "sc", "singlecell": "sc", "BamTag": "tag", "bam_tag": "tag",
}


def _mode(name: str) -> str:
    """snake_case of a mode that may be written in CamelCase."""
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def check_tag(tag: str) -> str:
    if not isinstance(tag, str) or len(tag) != 2:
        raise ConfigError("BAM tag must be 2 letters")
    if not re.match("[A-Za-z]", tag[0]):
        raise ConfigError("BAM tag must start with [A-Za-z]")
    if not re.match("[A-Za-z0-9]", tag[1]):
        raise ConfigError("BAM tag 2nd letter must conform to [A-Za-z0-9]")
    return tag


@dataclass
class Source:
    mode: str
    filename: str = ""
    subformat: str = "autodetect"
    feature: str = ""
    id_attribute: str = ""
    aggr_id_attribute: str = ""
    duplicate_handling: str = "collapse"
    tag: str = ""


@dataclass
class Strategy:
    overlap: str = "union"
    multi_region: str = "count_both"
    direction: str = "forward"


@dataclass
class Barcodes:
    extract: dict
    separator: str
    max_hamming: int = 0
    whitelist_files: list[str] = field(default_factory=list)


@dataclass
class Config:
    bam: str
    source: Source
    correct_clipping: bool = True
    max_skip_length: int = 150
    filters: list[dict] = field(default_factory=list)
    strategy: Strategy = field(default_factory=Strategy)
    dedup_mode: str = "none"
    dedup_bucket: str = "per_position"
    umi: dict | None = None
    barcodes: Barcodes | None = None
    directory: str = "output"
    write_annotated_bam: bool = False
    only_correct: bool = False


_FILTERS = ("multimapper", "non_primary", "read1", "read2", "spliced", "reference", "n_in_umi", "polyx_umi", "polya_umi")


def _extractor(section: str, data: dict) -> dict:
    mode = _SPELLINGS.get(data.get("mode", ""), _mode(data.get("mode", "")))
    need = {"regex_name": ("regex",), "search_in_name": ("search", "skip", "len"), "read_region": ("start", "stop"), "tag": ("tag",)}
    if mode not in need:
        raise ConfigError(f"unknown mode `{data.get('mode')}` in {section}")
    for key in need[mode]:
        if key not in data and not (mode == "search_in_name" and key == "skip"):
            raise ConfigError(f"missing field `{key}` in {section}")
    if mode == "regex_name":
        try:
            regex, groups = patterns.translated(data["regex"])
        except patterns.PatternError as e:
            raise ConfigError(f"invalid regex in {section}: {e}") from e
        data = {**data, "regex": regex, "groups": groups}
    if mode == "read_region" and data["start"] >= data["stop"]:
        raise ConfigError(f"start must be smaller than stop in {section}")
    if mode == "tag":
        check_tag(data["tag"])
    return {**data, "mode": mode}


def _choice(value: str, allowed: tuple[str, ...], what: str) -> str:
    for name in (_SPELLINGS.get(value), _mode(value)):
        if name in allowed:
            return name
    raise ConfigError(f"unknown variant `{value}`, expected one of {', '.join(allowed)} for {what}")


def from_dict(data: dict) -> Config:
    """Checks dedup, filters, input, umi, barcodes, in this order."""
    data = dict(data)
    if "deduplication" in data:
        data["dedup"] = data.pop("deduplication")
    if "UMI" in data:
        data["umi"] = data.pop("UMI")
    top = _take("the configuration", data, {"input": ..., "filter": [], "strategy": {}, "dedup": ..., "umi": None, "cell_barcodes": None, "output": ...})
    box = _take("input", top["input"], {"bam": ..., "correct_reads_for_clipping": True, "max_skip_length": 150, "source": ...})
    src = dict(box["source"])
    mode = _choice(src.pop("mode", ""), ("gtf", "bam_references", "bam_tag"), "input.source.mode")
    strategy = _take("strategy", top["strategy"], {"overlap": "union", "multi_region": "count_both", "direction": "forward"})
    # dedup keeps unknown keys without complaint
    mode_of_dedup = _choice(top["dedup"].get("mode", ""), ("none", "umi", "sc"), "dedup.mode")
    bucket = _choice(top["dedup"].get("bucket", "PerPosition"), ("per_position", "per_reference"), "dedup.bucket")
    for key, what in (("cell_barcodes", "cell barcodes"), ("umi", "UMI extraction")):
        if mode_of_dedup == "sc" and top[key] is None:
            raise ConfigError(f"SingleCell quantification requires {what} to be defined in the configuration.")
    if mode_of_dedup == "umi" and top["umi"] is None:
        raise ConfigError("UMI deduplication quantification requires UMI extraction to be defined in the configuration.")
    filters = []
    for f in top["filter"]:
        name = _choice(f.get("mode", ""), _FILTERS, "filter.mode")
        action = _choice(f.get("action", ""), ("keep", "remove"), "filter.action")
        if name == "reference" and not f.get("references"):
            raise ConfigError("Reference filter requires at least one reference to filter on.")
        filters.append({"mode": name, "action": action, "references": list(f.get("references", []))})
    if not box["bam"]:
        raise ConfigError("BAM filename can not be an empty string")
    if mode == "gtf":
        src = _take("input.source", src, {"filename": ..., "subformat": "AutoDetect", "feature": ..., "id_attribute": ..., "aggr_id_attribute": None, "duplicate_handling": "collapse"})
        for key in ("filename", "feature", "id_attribute"):
            if not src[key]:
                raise ConfigError(f"{key} can not be an empty string")
        subformat = _choice(src["subformat"], ("auto_detect", "gff", "gtf"), "subformat")
        twice = _choice(src["duplicate_handling"], ("collapse", "rename"), "duplicate_handling")
        source = Source("gtf", src["filename"], subformat, src["feature"], src["id_attribute"], src["aggr_id_attribute"] or src["id_attribute"], twice)
    elif mode == "bam_tag":
        tag = check_tag(_take("input.source", src, {"tag": ...})["tag"])
        if tag != tag.upper():
            raise ConfigError("BAM tag of a source must be upper case")
        source = Source("bam_tag", tag=tag)
    else:
        _take("input.source", src, {})
        source = Source("bam_references")
    umi = _extractor("umi", top["umi"]) if top["umi"] is not None else None
    barcodes = None
    if top["cell_barcodes"] is not None:
        b = _take("cell_barcodes", top["cell_barcodes"], {"extract": ..., "separator_char": ..., "max_hamming": 0, "whitelist_files": []})
        sep = b["separator_char"]
        if isinstance(sep, int) and 0 <= sep <= 255:
            sep = chr(sep)
        if not isinstance(sep, str) or len(sep) != 1:
            raise ConfigError("separator_char must be one character or a number below 256")
        barcodes = Barcodes(_extractor("cell_barcodes.extract", b["extract"]), sep, int(b["max_hamming"]), list(b["whitelist_files"]))
    out = _take("output", top["output"], {"directory": ..., "write_annotated_bam": False, "only_correct": False})
    policy = Strategy(
        _choice(strategy["overlap"], ("union", "intersection_strict", "intersection_non_empty"), "overlap"),
        _choice(strategy["multi_region"], ("drop", "count_both"), "multi_region"),
        _choice(strategy["direction"], ("forward", "reverse", "ignore"), "direction"),
    )
    return Config(
        box["bam"], source, box["correct_reads_for_clipping"], box["max_skip_length"], filters, policy,
        mode_of_dedup, bucket, umi, barcodes, out["directory"], out["write_annotated_bam"], out["only_correct"],
    )


def load(path: str | Path) -> Config:
    with open(path, "rb") as f:
        return from_dict(tomllib.load(f))
