"""Spelling variant grouping by anagram hashing.

Words are counted over the whole corpus. A word's key is the sum of the fifth
powers of its code points (modulo a prime), so all words of the same letters
share it, and a letter added, removed or exchanged changes it by that letter's
power. Words differ by one letter if their keys do: each word gives the keys that
are left when one of its letters is taken away. Two words that meet in such a key
by different letters have exchanged one for the other; a word whose own key is
met lacks the letter. Candidates are then verified by the order of their letters.

Many words of the same letters would make all pairs of a key candidates. Keys
that more than HOT words meet in are therefore split by what is left of the word
and where the letter stood, which only near words share, so no pair is emitted
in vain there and none is lost.

A word's form is its most frequent near word, if that is RATIO times as frequent.
Forms lead to roots: pointers are doubled, and as every step multiplies the count
by RATIO a few rounds do.

Defined cases: null text has no words; a null doc_id counts as an empty one;
repeated rows count again; ties of frequency go to the first word in code-point
order; very long texts are read in whole, and runs of any length are words (keys
are taken modulo a prime and do not overflow); an empty table has no words; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, sized, table, text_chunks

LEAST_LETTERS, LEAST_COUNT, RATIO, DAMAGE = 7, 2, 10, 31
#: Words in a key beyond which it is split.
HOT = 64
#: Different words that a task counts before it hands them on.
COUNTED = 50_000
PRIME = (1 << 61) - 1
LETTER = r"A-Za-zÀ-ÿ"
_RUN = re.compile(f"[{LETTER}]{{{LEAST_LETTERS},}}")
_LOWER = {c: c + 32 for c in range(65, 91)}


def damaged(doc: str, run: str) -> str:
    """The lower-cased run, without a letter if the contract's hash says so."""
    h = zlib.crc32(f"{doc}:{run}".encode())
    return run if h % DAMAGE else run[: h % len(run)] + run[h % len(run) + 1 :]


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: Counter[str] = Counter()
    for frame in frames:
        for part in text_chunks(frame):
            for doc, text in zip(part["doc"].tolist(), part["text"].tolist()):
                for run, n in Counter(_RUN.findall(text)).items():
                    word = damaged(doc, run.lower() if run.isascii() else run.translate(_LOWER))
                    if len(word) >= LEAST_LETTERS:
                        counts[word] += n
            if len(counts) >= COUNTED:
                yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})
                counts.clear()
    if counts:
        yield pd.DataFrame({"word": list(counts), "n": list(counts.values())})


def _power(letter: Column) -> Column:
    c = F.ascii(letter).cast("long")
    return c * c * c * c * c


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n and key of the words with LEAST_COUNT occurrences or more."""
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    words = own.mapInPandas(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)
    # powers stay below 2**41, so a sum below PRIME and a power fit a long
    key = F.aggregate(F.split("word", ""), F.lit(0).cast("long"), lambda a, c: F.pmod(a + _power(c), F.lit(PRIME)))
    return words.withColumn("key", key)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways, each pair of near words of (word, n, key) once."""
    taken = words.withColumn("letter", F.explode(F.array_distinct(F.split("word", "")))).withColumn("left_key", F.pmod(F.col("key") - _power(F.col("letter")), F.lit(PRIME)))
    taken = materialize(taken.drop("key"), "letters")
    meet = taken.groupBy(F.col("left_key").alias("k")).agg(F.count(F.lit(1)).alias("c")).unionByName(words.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("c")))
    hot = sized(materialize(meet.groupBy("k").agg(F.sum("c").alias("c")).where(F.col("c") > HOT).select(F.col("k").alias("left_key")), "hot"))
    few, many = taken.join(hot, "left_key", "left_anti"), taken.join(hot, "left_key", "left_semi")
    near = F.levenshtein("a.word", "b.word", 1) == 1
    pair = ["a.word", "a.n", F.col("b.word").alias("near"), F.col("b.n").alias("near_n")]
    exchanged = few.alias("a").join(few.alias("b"), (F.col("a.left_key") == F.col("b.left_key")) & (F.col("a.word") < F.col("b.word")) & (F.col("a.letter") != F.col("b.letter")) & near).select(*pair)
    lacking = few.alias("a").join(words.alias("b"), (F.col("a.left_key") == F.col("b.key")) & near).select(*pair)
    # every place of the letter, and the rest of the word
    places = F.filter(F.sequence(F.lit(1), F.length("word")), lambda p: F.substring(F.col("word"), p, F.lit(1)) == F.col("letter"))
    rest = F.concat(F.expr("substring(word, 1, place - 1)"), F.expr("substring(word, place + 1)"))
    many = materialize(many.withColumn("place", F.explode(places)).withColumn("rest", rest), "places")
    same = (F.col("a.left_key") == F.col("b.left_key")) & (F.col("a.rest") == F.col("b.rest")) & (F.col("a.place") == F.col("b.place"))
    exchanged_many = many.alias("a").join(many.alias("b"), same & (F.col("a.word") < F.col("b.word"))).select(*pair)
    lacking_many = many.dropDuplicates(["word", "rest"]).alias("a").join(words.alias("b"), (F.col("a.left_key") == F.col("b.key")) & (F.col("a.rest") == F.col("b.word"))).select(*pair)
    pairs = materialize(exchanged.unionByName(lacking).unionByName(exchanged_many).unionByName(lacking_many), "pairs")
    return pairs.select("word", "near", "near_n").unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where following forms ends."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = after.where("moved").limit(1).count()
        discard(now)
        now = after
        if not moved:
            return now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the corpus."""
    words = materialize(vocabulary(docs), "words")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    formed = F.col("n") * RATIO <= -F.col("best.n")
    known = words.select("word", "n").join(best, "word", "left")
    known = materialize(known.select("word", F.when(formed, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, -F.col("best.n")).alias("form_n")), "variants")
    ends = roots(known.where("form IS NOT NULL").select("word", "form"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


OP11_SQL = f"""
WITH RECURSIVE crcs AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
r AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL),
o AS (SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [(192 | (ord(c) >> 6))::BIGINT, (128 | (ord(c) & 63))::BIGINT] END)) AS octets FROM r),
h AS (SELECT run, n, xor(list_reduce(octets, lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8), 4294967295::BIGINT), 4294967295) AS h FROM o, crcs),
w AS (SELECT CASE WHEN h % {DAMAGE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= {LEAST_LETTERS} AND sum(n) >= {LEAST_COUNT}),
c AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM c a JOIN c b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, w.word, w.n FROM c JOIN w ON c.rest = w.word UNION SELECT w.word, c.word, c.n FROM c JOIN w ON c.rest = w.word),
b AS (SELECT word, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, near)) AS near FROM p GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= {RATIO} * w.n THEN b.near END AS form, CASE WHEN b.most >= {RATIO} * w.n THEN b.most END AS form_n FROM w LEFT JOIN b USING (word)),
g AS (SELECT word, word AS root FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL),
e AS (SELECT g.word, g.root FROM g JOIN f ON f.word = g.root WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""
