"""Quality rules: a threshold table compiled into one native projection.

Every figure comes from built-in functions over the whole text, so the operator
is a single narrow stage: no shuffle, no Python, and nothing held beyond one row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brontide.llm.common import WHITE, Plain, let, white_words

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can has there been if would who no more "
    "der die das und ist nicht mit von den des ein eine auf für im sich dem als auch es zu werden aus hat dass sie nach bei um noch wie einem über so zum war haben nur oder "
    "le la les et est un une dans pour que qui sur par pas avec ce il au plus ne se sont du mais ou nous comme leur sa son ses aux cette "
    "el los las y en que una por con para del se no su al lo como más o pero sus le ya este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos"
).split()


@dataclass(frozen=True)
class Rule:
    """A row of the threshold table: a document fails if metric is outside [low, high].

    slack: so many more of the metric's numerator are granted before it is found
    too low, and so many less before it is found too high.  A rule thus holds at
    every length, and a short text needs more than bad luck to fail.
    """

    name: str
    metric: str
    low: float | None = None
    high: float | None = None
    slack: int = 0


#: The production table.  Ratios are to words or lines, as the metric's name says.
RULES = (
    Rule("word_length", "chars_per_word", 1.5, 25.0),
    Rule("symbols", "symbols_per_word", None, 0.3),
    Rule("stop_words", "stop_words_per_word", 0.01, None, 2),
    Rule("line_copies", "dup_lines_per_line", None, 0.4),
    Rule("line_length", "words_per_line", 2.0, None, 50),
)

_SYMBOLS = "#*$%&|<>"
_WINDOW = 5


def _covered(words: Column) -> Column:
    """Words in 5-word windows found twice or more in the text, the first occurrence included.

    A set of 64-bit hashes tells texts without any repeated window apart, in one
    pass.  The others sort half of each hash with its position, packed in one
    long, and only windows beside an equal half are then compared as strings, so
    the count is free of collisions.
    """
    starts = F.sequence(F.lit(0), F.size(words) - _WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(_WINDOW))))
    window = lambda p: F.concat_ws(" ", *(F.get(words, p + k) for k in range(_WINDOW)))
    zero = F.lit(0).cast("bigint")

    def candidates(packed: Column) -> Column:
        half = lambda x: F.shiftright(x, 32)
        beside = lambda x, i: (half(F.get(packed, i + 1)) == half(x)) | ((i > 0) & (half(F.get(packed, i - 1)) == half(x)))
        return F.transform(F.filter(packed, beside), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))

    def repeated(found: Column) -> Column:
        beside = lambda x, i: (F.get(found, i + 1)["w"] == x["w"]) | ((i > 0) & (F.get(found, i - 1)["w"] == x["w"]))
        return F.array_sort(F.transform(F.filter(found, beside), lambda x: x["p"]))

    def total(at: Column) -> Column:
        steps = F.transform(at, lambda p, i: F.least(F.lit(_WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(_WINDOW))))
        return F.aggregate(steps, zero, lambda a, x: a + x)

    def exact(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(x, 32).bitwiseOR(i.cast("bigint"))))
        named = lambda at: F.array_sort(F.transform(at, lambda p: F.struct(window(p).alias("w"), p.alias("p"))))
        return let(let(named(let(packed, candidates)), repeated), total)

    some = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), exact(h)).otherwise(zero))
    return F.when(F.size(words) <= _WINDOW, zero).otherwise(some)


def _figures(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    bare = text
    for c in _SYMBOLS:
        bare = F.replace(bare, F.lit(c), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    stop = {x for w in STOP_WORDS for x in (w, w.capitalize(), w.upper())}

    def of(words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.length(F.array_join(words, "")).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(bare)).cast("bigint").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"),
            _covered(words).alias("n_repeat_words"),
            F.size(F.filter(words, lambda w: F.rtrim(w, F.lit(".,")).isin(sorted(stop)))).cast("bigint").alias("n_stop_words"),
            F.size(lines).cast("bigint").alias("n_lines"),
        )

    return let(white_words(text), lambda w: let(lines, lambda x: of(w, x)))


def _compiled(rules: tuple[Rule, ...], f: Column) -> Column:
    """The names of the rules that fail, in the table's order."""
    metrics = {
        "words": ("n_words", None),
        "chars_per_word": ("word_chars", "n_words"),
        "symbols_per_word": ("n_symbols", "n_words"),
        "stop_words_per_word": ("n_stop_words", "n_words"),
        "dup_lines_per_line": ("n_dup_lines", "n_lines"),
        "words_per_line": ("n_words", "n_lines"),
    }

    def metric(r: Rule, granted: int) -> Column:
        a, b = metrics[r.metric]
        value = (f[a] + F.lit(granted)).cast("double")
        return F.when(f[b] > 0, value / f[b]) if b else value

    checks = []
    for r in rules:
        bad = F.lit(False)
        if r.low is not None:
            bad = bad | (metric(r, r.slack) < r.low)
        if r.high is not None:
            bad = bad | (metric(r, -r.slack) > r.high)
        checks.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(r.name)))
    return F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, prefix: str = "") -> DataFrame:
    """docs with the figures, base_failed, failed_rules and kept appended.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated
    5-word windows.  kept: not base_failed and no rule of the table fails.

    Null and empty texts have no words, so they are base_failed.  A metric whose
    denominator is zero passes its rule.  Columns of docs that share a name, in any
    case, with an appended one are replaced; set prefix to keep both.  Repeated rows and an
    empty table need no special case: each row is judged by itself.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")
    table = Plain(docs, [prefix + m for m in (*made, "base_failed", "failed_rules", "kept")])

    def verdict(f: Column) -> Column:
        base = (f["n_words"] < 10) | (F.lit(100) * f["n_repeat_words"] > F.lit(20) * f["n_words"])
        return let(_compiled(rules, f), lambda failed: F.struct(*(f[m].alias(prefix + m) for m in made), base.alias(prefix + "base_failed"), failed.alias(prefix + "failed_rules"), (~base & (F.size(failed) == 0)).alias(prefix + "kept")))

    # One row in, one row out: inline() puts the struct's fields beside the other columns and is worked out once.
    judged = table.df.select(*(f"c{i}" for i in table.kept), F.inline(F.array(let(_figures(F.col(table.name(text)).cast("string")), verdict))))
    return judged.select(*table.own(), *(F.col(prefix + m) for m in (*made, "base_failed", "failed_rules", "kept")))
