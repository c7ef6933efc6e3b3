"""Names, ids and answers in text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Other names of metrics.
METRIC_ALIASES = {"cspc": "csvc", "vocmem": "voc_mem", "mem_voc": "voc_mem", "vocf1": "voc_f1"}


def canonical_metric(name: Column) -> Column:
    """Lower case, other signs as one `_`, none at the ends; then the aliases."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    out = plain
    for alias, known in METRIC_ALIASES.items():
        out = F.when(plain == alias, F.lit(known)).otherwise(out)
    return out


def counterfactual_id(name: Column) -> Column:
    """counterfactual_1 -> counterfactual-001; anything else is kept."""
    digits = F.regexp_extract(name, r"(?i)^counterfactual[-_]0*(\d+)$", 1)
    padded = F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)
    return F.when(digits != "", F.concat(F.lit("counterfactual-"), padded)).otherwise(name)


def public_id(name: Column) -> Column:
    return F.regexp_replace(name, "^counterfactual-", "")


def comma_list(text: Column) -> Column:
    """Trimmed non-empty items in their order, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != ""))


def scale_answer(text: Column) -> Column:
    """`ANSWER: s` with s from 1 to 5 as (s - 1) / 4; null without one."""
    digit = F.regexp_extract(text, r"(?i)ANSWER\s*:\s*([1-5])\b", 1)
    return (F.when(digit != "", digit).try_cast("int") - 1) / F.lit(4.0)


def percent_score(text: Column) -> Column:
    """`<score>+12.5%</score>` as 0.125, within [-100, 100]; null otherwise."""
    number = F.regexp_extract(text, r"^\s*<score>\s*([+-]?\d+(?:\.\d+)?)\s*%\s*</score>\s*$", 1)
    value = F.when(number != "", number).try_cast("double")
    return F.when(F.abs(value) <= 100, value / F.lit(100.0))


#: Phrases and forms by which an answer says what is done or what comes next.
FINISHED = "this task is finished because"
COMPLETED = "All tasks are completed."
ITEM = r"(?:[-*\u2022]|\d+(?:\.\)|[.):]|[ \t]*[-\u2013\u2014:]))[ \t]+"
VERBS = "Place Pick Put Grasp Grab Move Lift Hang Insert Fold Close Open Press Push Pull Stack Sweep Rotate Turn Release Slide Align Remove Take Set Hold Carry Position Arrange Store".split()
#: A progress tag; writers put a backslash or white space before the bracket and inside the word.
OPEN_TAG, CLOSE_TAG = (rf"\\?\s*<\s*{slash}progr\\?\s*ess\s*>" for slash in ("", r"/\s*"))
ALL_DONE = rf"(?is){OPEN_TAG}\s*100(?:\.0+)?\s*%\s*{CLOSE_TAG}"
PERCENT = rf"(?is){OPEN_TAG}\s*(\d+(?:\.\d+)?)\s*%\s*{CLOSE_TAG}"
NUMBER_APART = r"(?<!\d)(\d+)\s+(\d+)(?=\s*:)"
FIRST_ITEM = rf"(?ms)^[ \t]*{ITEM}(.+?)(?=\n[ \t]*(?:{ITEM}|Therefore\b)|\z)"
ITEM_NUMBER = r"^\d+\s*[:\u2013\u2014-]\s*"
BEFORE_PROGRESS = r"(?is)^(.*?)\s*Therefore,\s*the estimated progress is\s*<progress>\s*\d+(?:\.\d+)?\s*%\s*</progress>\s*\.?\s*$"
ONE_ACTION = rf"(?i)^((?:{'|'.join(VERBS)})\b[^\n<>]+[.!])$"
AFTER_LABEL = r"(?is)\bsubtask\s*:\s*(.*)$"
VERDICT, LOOSE_VERDICT = r"(?ims)^(.*?)(?:^|(?<=[.!?]))[ \t]*(yes|no)\b", r"(?is)^(.*?)\b(yes|no)\b"


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_unescape(text: Column) -> Column:
    """All named and numbered entities of HTML, by the standard library: its table has no counterpart among Spark's functions."""
    return _unescaped(text)


def listed_subtask(text: Column) -> Column:
    """The subtask that an answer names; null if none can be told.

    In turn: a phrase that all is finished or a progress of 100 %; the first item
    of a list; a description before the estimated progress; one sentence that
    begins with a verb of action.
    """
    plain = html_unescape(F.replace(F.replace(F.replace(text, F.lit("\\r\\n"), F.lit("\n")), F.lit("\\n"), F.lit("\n")), F.lit("\\r"), F.lit("\r")))
    plain = F.regexp_replace(plain, NUMBER_APART, "$1$2")
    done = F.contains(F.lower(plain), F.lit(FINISHED)) | plain.rlike(ALL_DONE)
    one_space = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    item = F.regexp_replace(one_space(F.regexp_extract(plain, FIRST_ITEM, 1)), ITEM_NUMBER, "")
    prose = one_space(F.regexp_extract(F.trim(plain), BEFORE_PROGRESS, 1))
    action = F.regexp_extract(F.trim(plain), ONE_ACTION, 1)
    return F.when(done, COMPLETED).when(item != "", item).when(prose.rlike("[A-Za-z]"), prose).when(action != "", action)


def progress_percent(text: Column) -> Column:
    """`<progress>12.5%</progress>` as 0.125, the tag escaped or split too; 1 where the text says that all is finished; null otherwise."""
    plain = html_unescape(text)
    number = F.regexp_extract(plain, PERCENT, 1)
    return F.when(number != "", F.when(number != "", number).try_cast("double") / F.lit(100.0)).when(F.contains(F.lower(plain), F.lit(FINISHED)), 1.0)


def labelled_answer(text: Column) -> Column:
    """(subtask, answer): what stands between `Subtask:` and the verdict yes or no; without the label, the text before a verdict that follows a sentence.

    Null subtask where it is empty or there is no verdict.
    """
    label = text.rlike(r"(?i)\bsubtask\s*:")
    after = F.regexp_extract(text, AFTER_LABEL, 1)
    strict, loose = VERDICT, LOOSE_VERDICT
    pick = lambda group: F.when(label, F.when(after.rlike(strict), F.regexp_extract(after, strict, group)).otherwise(F.regexp_extract(after, loose, group))).otherwise(F.regexp_extract(text, strict, group))
    subtask, answer = F.trim(pick(1)), F.lower(pick(2))
    return F.struct(F.when(subtask != "", subtask).alias("subtask"), F.when(answer != "", answer).alias("answer"))


def subtask_text(text: Column) -> Column:
    return labelled_answer(text)["subtask"]


def candidate_labels(candidates: Column) -> Column:
    """Labels '1' to '9' -> ids of a map id -> description, in the order of the ids; null for none or more than nine."""
    ids = F.array_sort(F.map_keys(candidates))
    labels = F.map_from_arrays(F.transform(ids, lambda x, i: (i + 1).cast("string")), ids)
    return F.when(F.size(ids).between(1, 9), labels)


def judge_prompt(instruction: Column, candidates: Column, answer: Column) -> Column:
    """The question to a judge: the task, the numbered candidates and the model's answer; one digit is asked for."""
    ids = F.array_sort(F.map_keys(candidates))
    choices = F.array_join(F.transform(ids, lambda x, i: F.concat(F.lit("- "), (i + 1).cast("string"), F.lit(": "), F.element_at(candidates, x))), "\n")
    return F.concat_ws("\n\n", F.lit("Choose the candidate that the answer names, also where it is vague."), F.concat(F.lit("Task:\n"), instruction), F.concat(F.lit("Candidates:\n"), choices), F.concat(F.lit("Answer:\n"), answer), F.lit("Reply with one digit."))


def html_escape(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def numbered_choices(labels: Column) -> Column:
    return F.array_join(F.transform(labels, lambda x, i: F.format_string("%d. %s", i + 1, x)), "\n")
