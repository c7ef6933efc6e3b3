"""Names of models, judges, tasks and files, and the parts of query ids."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values: (model, pattern in the checkpoint's last path part, name; {} is the pattern's group). The first that fits names the baseline.
SIZES = [
    ("topreward", r"(?<!\d)32b(?!\d)", "topreward_qwen32b"),
    ("robodopamine", r"(?<!\d)2\.0[-_]([48])b[-_]preview", "robodopamine_2_0_{}b_preview"),
    ("robodopamine", r"(?<!\d)(?:grm[-_])?([348])b$", "robodopamine_{}b"),
    ("rynnvalue", r"(?<!\d)([48])b(?!\d)", "rynnvalue_{}b"),
    ("vlac", r"(?<!\d)([28])b(?!\d)", "vlac_{}b"),
    ("roboreward", r"(?<!\d)4b(?!\d)", "roboreward_4b"),
    ("roboreward", r"(?<!\d)8b(?!\d)|^roboreward$", "roboreward_8b"),
]
#: Models whose unknown checkpoints are part of the name.
NAMED_BY_CHECKPOINT = ("robodopamine", "rynnvalue", "roboreward", "topreward", "vlac")
#: Stems that some file systems reserve.
RESERVED = {"con", "prn", "aux", "nul", *(f"{device}{n}" for device in ("com", "lpt") for n in range(1, 10))}


def task_name(text: Column) -> Column:
    """Lower case, other signs as one `_`, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def file_name(text: Column) -> Column:
    """Other signs than letters, digits, `.`, `_` and `-` as one `-`, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "[^a-z0-9._-]+", "-"), "^-+|-+$", "")


def baseline_name(model: Column, checkpoint: Column, backend: Column, shot: Column) -> Column:
    """The name under which results of a model and checkpoint go; never a guess of an unknown size.

    backend is the language model of topreward, shot is one_shot or zero_shot
    (vlac) or lora (procvlm).
    """
    name = F.lower(F.element_at(F.split(F.regexp_replace(F.coalesce(checkpoint, F.lit("")), "/+$", ""), "/"), -1))
    safe = file_name(name)
    some = F.when(safe != "", safe).otherwise("unknown")
    out = F.when((model == "topreward") & (backend == "molmo"), F.concat(F.lit("topreward_molmo__"), some))
    suffix = F.when(model == "vlac", F.concat(F.lit("_"), shot)).otherwise("")
    for known, pattern, label in SIZES:
        made = F.concat(F.lit(label.split("{}")[0]), F.regexp_extract(name, pattern, 1), F.lit(label.split("{}")[1])) if "{}" in label else F.lit(label)
        out = out.when((model == known) & name.rlike(pattern), F.concat(made, suffix))
    out = out.when((model == "vlac") & (name == ""), F.concat(F.lit("vlac__unknown"), suffix))
    out = out.when(model.isin(*NAMED_BY_CHECKPOINT) & (name != ""), F.concat(model, F.lit("__"), some, suffix))
    return out.when((model == "procvlm") & (shot == "lora"), "procvlm_one-shot").otherwise(F.coalesce(model, F.lit("unknown")))


def judged_name(baseline: Column, judge: Column) -> Column:
    """A baseline whose scores depend on a judge carries its name."""
    return F.concat(baseline, F.lit("__sia-judge-"), F.regexp_replace(F.coalesce(judge, F.lit("unknown")), "[^A-Za-z0-9._-]+", "-"))


def query_metric(query_id: Column) -> Column:
    return F.substring_index(query_id, ":", 1)


def query_target(query_id: Column) -> Column:
    return F.substring_index(query_id, ":", -1)


def check_components(names: Iterable[str], task_names: bool = False) -> None:
    """Raise if a name cannot be a path component everywhere, or two names are one on some file systems."""
    seen: dict[str, str] = {}
    for name in names:
        if not isinstance(name, str) or name in ("", ".", "..") or name[-1] in ". " or any(c < " " or c in '<>:"/\\|?*' for c in name):
            raise ValueError(f"not a portable name: {name!r}")
        folded = unicodedata.normalize("NFC", name).casefold()
        if folded.partition(".")[0] in RESERVED or (task_names and folded == "summary"):
            raise ValueError(f"reserved name: {name!r}")
        if seen.setdefault(folded, name) != name:
            raise ValueError(f"names that collide: {seen[folded]!r}, {name!r}")
