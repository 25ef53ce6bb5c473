r"""Personal data: fixed shapes, and identifiers bootstrapped from their contexts.

Built-in functions only. Four kinds have fixed shapes (email, ip, card, phone).
Their instances are the seeds of a graph between instances and lexical patterns,
a pattern being the word, or the two words, in front of an instance or behind it.
Words are parted by blanks, brackets, quotes and the signs , ; : = |, so a name that
is joined to its value (email:a@b.c, id=X7101Q) is a pattern too, and an identifier
does not hold the comma or the full stop behind it. The graph is
scored until a round accepts no new pattern: a pattern's confidence is the share of all its occurrences
in the corpus that stand beside an instance, each weighed by its score, and a new
instance's score is the noisy-or of its confident patterns. A pattern counts only
with SUPPORT different instances of score 1 or discovered before. Identifier-like
words that confident patterns reach are reported as kind context.

Positions are running totals of the texts between matches, split off by the same
pattern, and the words beside a match are read from these texts, so the time
grows with a text's length. The graph has one row for each pattern and
instance, counted before the shuffle; texts are never shuffled. Patterns are
joined to the corpus's words by broadcast while they are measured to be few.

Spans are (kind, start, end) in code points, end exclusive.

Defined cases: null text counts as empty and has no spans; rows that repeat a
doc_id are searched each for itself; an empty table gives no rows; columns other
than id and text are not read; an instance at the beginning or end of a text has no pattern
on that side, nor has one whose words there run into the third match of its kind from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.arrays import bound, running_max, running_sum
from palisade.llm.store import small_enough, written

KINDS = ("email", "ip", "card", "phone")
#: The shapes. Lookbehinds and possessive quantifiers only spare starts that must fail; \G lets a match begin where the last ended.
SHAPES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a shape to be searched at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
#: What parts words of contexts and identifiers: blanks, brackets, quotes and signs that join a name to its value.
PARTING = r"\x20\x09-\x0D()<>\[\]{}\"'`,;:=|"
WORD, BLANK = f"[^{PARTING}]", f"[{PARTING}]"
#: Words with a digit or @, without signs that end a sentence behind them.
IDENTIFIER = rf"(?<!{WORD})[^{PARTING}0-9@]*+[0-9@](?:{WORD}*[^{PARTING}.!?])?"
SUPPORT, CONFIDENT, LEAST_DIGITS, SHORTEST = 5, 0.8, 4, 6
#: Code points in which the words beside a match are sought first, and a mark for where known text begins inside a word.
NEAR, TORN, FAR = 128, "\x01", 1 << 40
#: In front of patterns that stand behind their instances; no word holds it.
BEHIND = ">"


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digit string passes the check of card numbers."""
    at = F.split(F.reverse(digits), "")
    doubled = F.transform(at, lambda d, i: F.when(i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
    digits = only_digits(m)
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


SPAN = "array<struct<kind:string,start:long,end:long>>"
MARK = "array<struct<kind:string,start:long,end:long,instance:string,patterns:array<string>>>"


def patterns_before(m: Column, between: Column, i: Column) -> Column:
    """The word and the two words in front of match i, '' where there are none, from the texts around the matches before."""
    close = F.substring(F.get(between, i), -NEAR, NEAR)
    fast = F.regexp_extract(close, rf"{BLANK}({WORD}+{BLANK}+{WORD}+){BLANK}+$", 1)

    def slow() -> Column:
        piece = lambda a, k: F.coalesce(F.get(a, i - k), F.lit(""))
        whole = F.concat(F.when(i > 2, TORN).otherwise(""), piece(between, 2), piece(m, 2), piece(between, 1), piece(m, 1), piece(between, 0))
        found = lambda w: bound(F.regexp_extract(w, rf"(?<!{WORD})({WORD}+{BLANK}+{WORD}+){BLANK}+$", 1), lambda two: F.when(two != "", two).otherwise(F.regexp_extract(w, rf"(?<!{WORD})({WORD}+){BLANK}+$", 1)))
        return bound(whole, found)

    words = bound(fast, lambda two: F.split(F.lower(F.when(two != "", two).otherwise(slow())), rf"{BLANK}+"))
    sound = lambda p: F.when(F.contains(p, F.lit(TORN)), "").otherwise(p)
    return bound(words, lambda w: F.array(sound(F.element_at(w, -1)), F.when(F.size(w) > 1, sound(F.array_join(w, " "))).otherwise("")))


def patterns_after(m: Column, between: Column, i: Column) -> Column:
    """The word and the two words behind match i, marked as such, '' where there are none, from the texts around the matches after."""
    close = F.substring(F.get(between, i + 1), 1, NEAR)
    fast = F.regexp_extract(close, rf"^{BLANK}+({WORD}+{BLANK}+{WORD}+){BLANK}", 1)

    def slow() -> Column:
        piece = lambda a, k: F.coalesce(F.get(a, i + k), F.lit(""))
        whole = F.concat(piece(between, 1), piece(m, 1), piece(between, 2), piece(m, 2), piece(between, 3), F.when(i + 3 < F.size(m), TORN).otherwise(""))
        found = lambda w: bound(F.regexp_extract(w, rf"^{BLANK}+({WORD}+{BLANK}+{WORD}+)", 1), lambda two: F.when(two != "", two).otherwise(F.regexp_extract(w, rf"^{BLANK}+({WORD}+)", 1)))
        return bound(whole, found)

    words = bound(fast, lambda two: F.split(F.lower(F.when(two != "", two).otherwise(slow())), rf"{BLANK}+"))
    sound = lambda p: F.when((p == "") | F.contains(p, F.lit(TORN)), "").otherwise(F.concat(F.lit(BEHIND), p))
    return bound(words, lambda w: F.array(sound(F.get(w, F.lit(0))), F.when(F.size(w) > 1, sound(F.array_join(w, " "))).otherwise("")))


def places(kind: str, text: Column, shape: str, valid) -> Column:
    """Marks of the matches of shape in text that are valid; failing matches are used up."""
    parts = F.struct(F.regexp_extract_all(text, F.lit(shape), F.lit(0)).alias("m"), F.split(text, shape, -1).alias("b"))

    def marks(p: Column) -> Column:
        ends = running_sum(F.zip_with(F.slice(p["b"], 1, F.size(p["m"])), p["m"], lambda gap, m: (F.length(gap) + F.length(m)).cast("long")))
        rows = F.filter(F.transform(ends, lambda end, i: F.struct(end.alias("end"), i.alias("i"))), lambda r: valid(F.get(p["m"], r["i"])))
        made = lambda r, m: F.struct(F.lit(kind).alias("kind"), (r["end"] - F.length(m)).alias("start"), r["end"].alias("end"), F.sha2(m, 256).alias("instance"), F.concat(patterns_before(p["m"], p["b"], r["i"]), patterns_after(p["m"], p["b"], r["i"])).alias("patterns"))
        return F.transform(rows, lambda r: made(r, F.get(p["m"], r["i"])))

    return bound(parts, marks)


def base_marks(text: Column) -> Column:
    none = F.array().cast(MARK)
    seen = lambda kind: F.contains(text, F.lit("@")) if kind == "email" else F.rlike(text, F.lit(HINTS[kind]))
    return F.concat(*[F.when(seen(k), places(k, text, SHAPES[k], lambda m, k=k: holds(k, m))).otherwise(none) for k in KINDS])


def apart(base: Column, other: Column) -> Column:
    """The marks of other that none of base overlaps: one sweep over both in order of start."""
    both = F.sort_array(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(-1).alias("at"))), F.transform(other, lambda o, i: F.struct(o["start"].alias("start"), o["end"].alias("end"), i.alias("at")))))
    upto = lambda a: running_max(F.transform(a, lambda x: F.when(x["at"] < 0, x["end"]).otherwise(F.lit(-1).cast("long"))))
    beyond = lambda a: F.reverse(running_max(F.reverse(F.transform(a, lambda x: F.when(x["at"] < 0, FAR - x["start"]).otherwise(F.lit(-1).cast("long"))))))

    def swept(a: Column, before: Column, after: Column) -> Column:
        hit = lambda x, i: (F.get(before, i) > x["start"]) | (FAR - F.get(after, i) < x["end"])
        free = F.filter(F.transform(a, lambda x, i: F.struct(x["at"].alias("at"), hit(x, i).alias("hit"))), lambda x: (x["at"] >= 0) & ~x["hit"])
        return F.transform(free, lambda x: F.get(other, x["at"]))

    return bound(both, lambda a: bound(upto(a), lambda before: bound(beyond(a), lambda after: swept(a, before, after))))


def searched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """row, doc_id, base spans, seeds and candidates with contexts."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    like = lambda m: (F.length(m) >= SHORTEST) & ((F.length(only_digits(m)) >= LEAST_DIGITS) | F.contains(m, F.lit("@")))
    text = F.col("text")
    other = F.when(F.rlike(text, F.lit("[0-9@]")), places("context", text, IDENTIFIER, like)).otherwise(F.array().cast(MARK))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", base_marks(text).alias("found"), other.alias("other"))
    free = F.when((F.size("found") == 0) | (F.size("other") == 0), F.col("other")).otherwise(apart(F.col("found"), F.col("other")))
    span = lambda b: F.struct(b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"))
    return written(rows.select("row", "doc_id", F.transform("found", span).alias("base"), F.concat("found", free).alias("marks")), "searched")


def pattern_totals(docs: DataFrame, text_col: str, patterns: DataFrame) -> DataFrame:
    """words, total: how often each of the words or pairs of words occurs in all texts."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), rf"{BLANK}+"), lambda w: w != "")
    both = docs.select(words.alias("w")).select(F.explode(F.concat("w", F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))).alias("words"))
    if small_enough(patterns):
        return both.join(F.broadcast(patterns), "words", "left_semi").groupBy("words").agg(F.count("*").alias("total"))
    return both.groupBy("words").agg(F.count("*").alias("total")).join(patterns, "words", "left_semi")  # counted in each task before the shuffle


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """doc_id, spans array<struct<kind, start, end>> by kind, then start; context last."""
    rows = searched(docs, id_col, text_col)
    marks = rows.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    graph = marks.select("instance", (F.col("kind") != "context").alias("seed"), F.explode("patterns").alias("pattern")).where("pattern <> ''")
    graph = written(graph.groupBy("pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed")), "graph")
    wide = written(graph.groupBy("pattern").agg(F.count("*").alias("k")).where(F.col("k") >= support).select("pattern"), "wide-patterns")
    said = F.regexp_replace("pattern", f"^{BEHIND}", "").alias("words")
    totals = written(pattern_totals(docs, text_col, written(wide.select(said).distinct(), "wide-words")), "pattern-totals")
    graph = written(graph.join(wide.select("pattern", said).join(totals, "words").drop("words"), "pattern"), "wide-graph")
    scores = graph.groupBy("instance").agg(F.max(F.when(F.col("seed"), 1.0).otherwise(0.0)).alias("score"))
    accepted = 0
    while True:
        weighed = graph.join(scores, "instance")
        good = weighed.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / F.max("total")).alias("confidence"), F.count_if(F.col("score") >= confident).alias("known"))
        good = written(good.where((F.col("known") >= support) & (F.col("confidence") >= confident)).select("pattern", F.least("confidence", F.lit(0.999)).alias("confidence")), "good-patterns")
        doubt = F.exp(F.sum(F.log1p(-F.coalesce("confidence", F.lit(0.0)))))
        scores = written(graph.join(good, "pattern", "left").groupBy("instance").agg(F.when(F.max("seed"), 1.0).otherwise(1 - doubt).alias("score")), "scores")
        before, accepted = accepted, good.count()  # scores only rise, so patterns once accepted stay
        if accepted == before:
            break
    reached = written(scores.where(F.col("score") >= confident).select("instance").join(graph.where("not seed").select("instance"), "instance", "left_semi"), "reached")
    new = marks.where("kind = 'context'").join(reached, "instance", "left_semi").groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("new"))
    spans = F.concat("base", F.sort_array(F.coalesce("new", F.array().cast(SPAN))))
    return rows.select("row", "doc_id", "base").join(new, "row", "left").select("doc_id", spans.alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    out = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "context")
    return out.select("doc_id", *[n(k) for k in KINDS], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
