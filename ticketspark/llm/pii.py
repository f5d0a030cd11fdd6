"""Personal data by patterns and information-theoretic sanitisation.

Patterns find protected entities (addresses, numbers). The corpus then says how strongly a
term of the same document gives an entity away: the pointwise mutual information of term
and entity against the information content of the entity itself. Terms beyond the disclosure
threshold are generalised or removed like the entities, wherever they stand in a document
that holds the entity.

Built-in functions only. Positions are code points from 0, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketspark.llm.common import plain
from ticketspark.operators.vocab import sized
from ticketspark.session import materialize

# The kinds in their order. The patterns give the same matches as the plain ones of the
# contract, but none takes more than linear time or a deep stack: runs are possessive,
# begin where a run begins (or where the match before ended), and of digit runs only
# those of 12 digits or more are cards.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a kind's pattern to be tried.
CUES = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": PATTERNS["card"], "phone": r"\+[0-9]"}
TERM = r"\p{L}{3,}"

# Share of an entity's information that a term may give, and from which on it is removed
# instead of generalised; different texts that must show the two together.
DISCLOSURE, REMOVAL, SUPPORT = 0.8, 0.95, 3


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.ascii(F.substring(d, i, F.lit(1))) - 48)
    doubled = F.transform(each, lambda x, i: F.when(i % 2 == 0, x).otherwise(
        F.when(x > 4, 2 * x - 9).otherwise(2 * x)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    n = F.length(_digits(value))
    part = F.regexp_replace  # leading zeros don't count
    small = F.forall(F.split(value, r"\."), lambda p: F.when(
        F.length(part(p, "^0+(?=[0-9])", "")) <= 3, p.cast("decimal(38,0)") <= 255).otherwise(False))
    return F.when(kind == KINDS.index("ip"), small).when(
        kind == KINDS.index("card"), F.when(n.between(12, 19), _luhn(value)).otherwise(False)).when(
        kind == KINDS.index("phone"), n.between(9, 15)).otherwise(True)


def entities(rows: DataFrame) -> DataFrame:
    """(_row, kind, start, end, value) of each base span of (_row, _found) rows, where
    ``_found`` holds for each kind the matches and the lengths of what stands between.
    Starts are running sums in a window over one text's matches of one kind."""
    one = rows.select("_row", F.posexplode("_found").alias("kind", "f")).where(F.size("f.m") > 0)
    one = one.select("_row", "kind", F.posexplode(F.arrays_zip(
        F.col("f.gap").alias("gap"), F.col("f.m").alias("m"))).alias("i", "x"))
    # the gap after the last match has no match of its own
    one = one.where(F.col("x.m").isNotNull()).select(
        "_row", "kind", "i", F.col("x.gap").alias("gap"), F.col("x.m").alias("value"))
    upto = Window.partitionBy("_row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("value")
    end = F.sum(F.col("gap") + n).over(upto)
    return one.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - n).where(
        F.coalesce(_valid(F.col("kind"), F.col("value")), F.lit(False))).select(
        "_row", "kind", "start", "end", "value")


def names(base: DataFrame) -> DataFrame:
    """(_row, entity): the distinct entities of each text; their spellings are one."""
    name = F.concat_ws(":", F.col("kind").cast("string"), F.when(
        F.col("kind") == 0, F.lower("value")).otherwise(_digits(F.col("value"))))
    return base.select("_row", name.alias("entity")).distinct()


def words(texts: DataFrame) -> DataFrame:
    """(_row, term, start, end) of each run of three letters or more of (_row, _text) rows.
    Starts are running sums in a window over one text's runs, so the work is linear in
    the text but for the sort."""
    # a text is cut once: what stands between the runs, and the runs
    cut = texts.select("_row", F.posexplode(F.arrays_zip(
        F.transform(F.split("_text", TERM, -1), F.length).alias("gap"),
        F.regexp_extract_all("_text", F.lit(TERM), F.lit(0)).alias("m"))).alias("i", "x")).where(
        F.col("x.m").isNotNull())
    upto = Window.partitionBy("_row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("m")
    return cut.select("_row", "i", "x.gap", "x.m").withColumn("end", F.sum(F.col("gap") + n).over(upto).cast("int")).select(
        "_row", F.lower("m").alias("term"), (F.col("end") - n).alias("start"), "end")


def outside(base: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of ``runs`` that no entity of ``base`` overlaps. Entities and runs of a text
    pass in order once forward, with the furthest end of an entity so far, and once
    backward, with the next entity's start."""
    both = runs.select("_row", "term", "start", "end").unionByName(
        base.select("_row", F.lit(None).cast("string").alias("term"), "start", "end"))
    entity = F.col("term").isNull()
    one = Window.partitionBy("_row")
    ahead = one.orderBy("start", F.col("term").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    back = one.orderBy(F.desc("start"), F.col("term").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_reach", F.max(F.when(entity, F.col("end"))).over(ahead)).withColumn(
        "_next", F.min(F.when(entity, F.col("start"))).over(back))
    return both.where(~entity & (F.coalesce("_reach", F.lit(0)) <= F.col("start")) & (
        F.coalesce("_next", F.col("end")) >= F.col("end"))).select("_row", "term", "start", "end")


def together(named: DataFrame) -> DataFrame:
    """(_row, text_id, entity): ``named`` with entities of the very same texts as one, the
    first of them, so that a list of addresses that goes from text to text is paired with a
    text's terms once. Sets of texts are told apart by their sizes and two 64-bit hashes."""
    sets = named.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("_row")).alias("x"),
        F.bit_xor(F.xxhash64(F.lit("again"), "_row")).alias("y"))
    first = sets.groupBy("n", "x", "y").agg(F.min("entity").alias("entity")).select("entity")
    return named.join(first, "entity")


def disclosing(holders: DataFrame, terms: DataFrame, total: int) -> DataFrame:
    """(entity, term, share, removed): terms that give ``DISCLOSURE`` of an entity's
    information or more. ``holders``: (_row, entity, n_entity, text_id) of each text and
    entity; ``terms``: distinct (_row, term, n_term). Counts are of documents; support
    counts different texts, so that copies of one text don't prove a link. A term of too
    many documents can't reach the threshold however often the two share one, and is left
    out before pairing. Pairs are combined within tasks first."""
    most = F.pow(F.col("n_entity"), F.lit(DISCLOSURE)) * total ** (1 - DISCLOSURE) * (1 + 1e-9)
    pairs = holders.join(terms, "_row").where(F.col("n_term") <= most)
    by_text = pairs.groupBy("entity", "term", "text_id").agg(
        F.count(F.lit(1)).alias("n"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    known = by_text.groupBy("entity", "term").agg(
        F.sum("n").alias("n_pair"), F.count(F.lit(1)).alias("texts"), F.first("n_entity").alias("n_entity"),
        F.first("n_term").alias("n_term")).where(F.col("texts") >= SUPPORT)
    info = F.log(F.lit(float(total)) / F.col("n_entity"))
    given = F.log(F.col("n_pair") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    return known.withColumn("share", F.when(info > 0, given / info).otherwise(0.0)).where(
        F.col("share") >= DISCLOSURE).select("entity", "term", "share", (F.col("share") >= REMOVAL).alias("removed"))


def _told(base: DataFrame, hit: DataFrame, frequency: DataFrame, total: int) -> DataFrame:
    """(_row, start, end, removed): every place of a disclosing term in the texts that hold
    its entity. ``hit``: (_row, _text, _id) of the rows with entities; ``frequency``: (term,
    n_term) of the corpus."""
    named = materialize(names(base).join(hit.select("_row", F.col("_id").alias("text_id")), "_row"), "pii-entities")
    by_text = named.groupBy("entity", "text_id").agg(F.count(F.lit(1)).alias("n"))
    shown = by_text.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count(F.lit(1)).alias("texts"))
    shown = sized(shown.where((F.col("texts") >= SUPPORT) & (F.col("n_entity") < total)).drop("texts"), "pii-shown")
    holders = materialize(together(materialize(named.join(shown, "entity"), "pii-held")), "pii-holders")
    most = shown.agg(F.max("n_entity")).first()[0] or 0  # as in disclosing(), for any entity
    asked = holders.select("_row").distinct()
    runs = materialize(words(hit.select("_row", "_text").join(asked, "_row", "left_semi")), "pii-words")
    # only the corpus frequency of words that stand in these texts is of use
    rare = sized(frequency.where((F.col("n_term") >= SUPPORT) & (
        F.col("n_term") <= most ** DISCLOSURE * total ** (1 - DISCLOSURE) * (1 + 1e-9))).join(
        runs.select("term").distinct(), "term"), "pii-rare")
    terms = outside(base.join(asked, "_row", "left_semi"), runs.join(rare, "term").drop("n_term"))
    terms = materialize(terms, "pii-terms")
    told = sized(disclosing(holders, terms.select("_row", "term").distinct().join(rare, "term"), total), "pii-told")
    marked = holders.join(told, "entity").groupBy("_row", "term").agg(F.max("removed").alias("removed"))
    return terms.join(marked, ["_row", "term"]).select("_row", "start", "end", "removed")


def pii(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) plus ``n_email``, ``n_ip``, ``n_card``, ``n_phone``,
    ``base_sha256`` (of the base spans as kind:start:end), ``spans`` (with the terms),
    ``n_term`` and ``found``, an array of (start, kind, end, removed) in order.

    A null or empty text holds nothing (the digest of no text). Every input row gives one
    row, repeated rows and null keys too: rows are told apart by a number of their own.
    Equal texts count as one text of support. Input columns named like an output give way
    to it; an empty table stays empty.
    """
    df = plain(df)
    outputs = ["n_email", "n_ip", "n_card", "n_phone", "n_term", "base_sha256", "spans", "found"]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in outputs]
    text = F.col(f"`{text_col}`")
    empty = F.lit(None).cast("struct<gap:array<int>,m:array<string>>")

    def matches(kind: str) -> Column:
        p = PATTERNS[kind]
        return F.when(text.rlike(CUES[kind]), F.struct(
            F.transform(F.split(text, p, -1), F.length).alias("gap"),
            F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("m"))).otherwise(empty)

    rows = df.select(*[F.col(f"`{c}`") for c in kept], text.alias("_text"),
                     F.array(*[matches(k) for k in PATTERNS]).alias("_found"),
                     F.monotonically_increasing_id().alias("_row"))
    any_found = F.exists("_found", lambda f: F.coalesce(F.size(f["m"]), F.lit(0)) > 0)
    rows = rows.withColumn("_hit", any_found)
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], "_row", "_hit", F.when(F.col("_hit"), F.col("_found")).alias(
        "_found"), F.when(F.col("_hit"), F.col("_text")).alias("_text"), F.when(
        F.col("_hit"), F.xxhash64("_text", F.length("_text"))).alias("_id"))
    rows = materialize(rows, "pii-rows")
    hit = rows.where("_hit")
    base = materialize(entities(hit.select("_row", "_found")), "pii-base")

    # documents that hold each term: one row a term leaves a task
    frequency = df.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all(
        text, F.lit(TERM), F.lit(0)), F.lower))).alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("n_term"))
    total = rows.count()
    terms = _told(base, hit.select("_row", "_text", "_id"), frequency, total)

    every = base.select("_row", "start", "kind", "end", F.lit(True).alias("removed")).unionByName(
        terms.select("_row", "start", F.lit(KINDS.index("term")).alias("kind"), "end", "removed"))
    by_row = materialize(every.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(
        "start", "kind", "end", "removed"))).alias("found")), "pii-found")
    out = rows.drop("_found", "_text", "_hit", "_id").join(by_row, "_row", "left").withColumn(
        "found", F.coalesce("found", F.array().cast(by_row.schema["found"].dataType)))

    def count(kind: str) -> Column:
        k = KINDS.index(kind)
        return F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{kind}")

    kind = F.array(*map(F.lit, KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", F.get(kind, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    return out.select(
        *[F.col(f"`{c}`") for c in kept], *[count(k) for k in KINDS[:4]],
        F.sha2(joined(F.filter("found", lambda x: x["kind"] < 4)), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"), count("term"), "found")


def sanitise(df: DataFrame, text_col: str = "text", found_col: str = "found") -> DataFrame:
    """``df`` without ``found_col``, its spans taken from the text: entities and generalised
    terms become their kind in angle brackets, removed terms go. Of spans that overlap,
    the first one's kind stands for all."""
    kind = F.array(*map(F.lit, KINDS))
    text, found = F.col(text_col), F.col(found_col)
    # spans with the furthest end before them, so that each piece is cut once
    placed = F.aggregate(found, F.named_struct(F.lit("end"), F.lit(0), F.lit("out"), F.array().cast("array<string>")),
                         lambda a, x: F.named_struct(
        F.lit("end"), F.greatest(a["end"], x["end"]), F.lit("out"), F.when(
            x["start"] >= a["end"], F.concat(a["out"], F.array(
                F.substring(text, a["end"] + 1, x["start"] - a["end"]),
                F.when((x["kind"] == 4) & x["removed"], "").otherwise(F.concat(
                    F.lit("<"), F.get(kind, x["kind"]), F.lit(">")))))).otherwise(a["out"])))
    return df.withColumn("_p", F.when(F.size(found) > 0, placed)).withColumn(
        text_col, F.when(F.size(found) > 0, F.concat(F.array_join("_p.out", ""), F.substring(
            text, F.col("_p.end") + 1, F.length(text)))).otherwise(text)).drop("_p", found_col)
