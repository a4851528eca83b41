"""New batches held against all that was accepted before (problem 7).

A record's content is its board, its place and the parts of its role; the parts are its paragraphs.
The accepted state keeps bucketed tables of hashes: of whole contents, of single paragraphs, and of
all paragraphs but one. A new record repeats an accepted one if its whole hash is there (a full copy),
or if all its paragraphs but one are covered by an accepted record and the two left over are the same
word but for one mistyped spot. Paragraphs that nothing accepted has rule most records out first.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postmill.plans.pointer import Pointers
from postmill.session import cut, shared_dir

# Appends after which the tables of a state are written anew, one file for each bucket.
COMPACT_AFTER = 16
# Links within one batch that one task works off in order; while there are more, whole levels of them go first.
ORDERED_LINKS = 1_000_000

# Usual shortenings of the words of job titles, and what they stand for.
SHORTENINGS = {
    "eng": "engineer", "engr": "engineer", "engnr": "engineer", "anlst": "analyst", "sci": "scientist", "prod": "product",
    "mgr": "manager", "mngr": "manager", "infra": "infrastructure", "hw": "hardware", "sw": "software", "fw": "firmware",
    "rsch": "research", "arch": "architect", "dsgnr": "designer", "des": "designer", "sec": "security", "quant": "quantitative",
    "sol": "solutions", "sols": "solutions", "soln": "solutions", "solns": "solutions", "net": "networking", "ntwk": "networking",
    "embd": "embedded", "appr": "apprentice", "grads": "grad", "graduate": "grad", "internship": "intern", "interns": "intern",
    "dev": "developer", "sr": "senior", "jr": "junior", "assoc": "associate", "asst": "assistant", "fe": "frontend", "be": "backend",
    "sre": "site reliability engineer", "swe": "software engineer", "sde": "software engineer", "mle": "machine learning engineer",
    "ml": "machine learning", "pm": "product manager", "qa": "quality assurance", "coop": "co op", "newgrad": "new grad", "ng": "new grad",
}
_NUMERALS = r"^([ivx]+|.*\p{N}.*)$"


def role_parts(title: Column, shortenings: dict[str, str] = SHORTENINGS) -> Column:
    """The sorted words of a title in lower case, shortenings written out; null and blank give none.

    The table of shortenings is fixed for a state: one that was learned anew would give accepted
    contents other hashes than they were stored with.
    """
    table = F.create_map(*[F.lit(x) for pair in (shortenings or {"": ""}).items() for x in pair])
    words = F.filter(F.split(F.lower(title), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    spelled = F.flatten(F.transform(words, lambda w: F.split(F.coalesce(F.element_at(table, w), w), " ")))
    return F.array_sort(F.coalesce(spelled, F.array().cast("array<string>")))


def one_slip(a: str, b: str) -> Column:
    """Whether two columns of words differ by one letter more, less or other, or by two neighbours swapped.

    Never between numerals, and never between words of one or two letters.
    """
    swapped = f"exists(sequence(1, greatest(length({a}) - 1, 1)), i -> concat(substring({a}, 1, i - 1), substring({a}, i + 1, 1), substring({a}, i, 1), substring({a}, i + 2)) = {b})"
    near = f"levenshtein({a}, {b}) <= 1 or (length({a}) = length({b}) and {swapped})"
    words = f"not {a} rlike r'{_NUMERALS}' and not {b} rlike r'{_NUMERALS}' and greatest(length({a}), length({b})) >= 3"
    return F.expr(f"{words} and {a} <> {b} and ({near})")


def _together(*steps: Callable) -> list:
    """What independent steps give, each of them a job or two that alone would leave cores idle."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(step) for step in steps]]


class AcceptedState:
    """Hashes of everything accepted so far, in bucketed tables under one folder.

    ``full`` (two hashes of a content, batch, number), ``paragraphs`` (hash of board, place and one
    word) and ``parts`` (two hashes of all words but one with a piece of that word, the word, batch,
    number). A batch is read against them by their buckets, so the state is neither shuffled nor are
    accepted texts read again; accepting a batch appends rows. ``open`` finds the state again, in
    this application or a later one: a numbered pointer names the tables, their number of buckets and
    the appends that count, so what a lost run appended is never read. Contents are told apart by 128 bits.
    """

    TABLES = {
        "full": ("h bigint, g bigint, batch_no int, seq bigint", ("h", "g")),
        "paragraphs": ("ph bigint", ("ph",)),
        "parts": ("lh bigint, lg bigint, word string, batch_no int, seq bigint", ("lh", "lg")),
    }

    def __init__(self, spark: SparkSession, path: str, number: int, document: dict) -> None:
        self.spark, self.path, self.number, self.document = spark, path, number, document
        self.buckets, self._known = document["buckets"], {}

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None) -> AcceptedState:
        """A new empty state; in the shared folder if no ``path`` is given."""
        path = path or f"{shared_dir(spark)}/accepted-{uuid.uuid4().hex}"
        document = {"buckets": buckets or max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))), "generation": uuid.uuid4().hex, "appends": [], "batches": []}
        return cls(spark, path, Pointers(spark, path).publish(document, 0), document)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> AcceptedState:
        """The state that was made at ``path``, as it was after its last accepted batch."""
        number, document = Pointers(spark, path).latest()
        if not number:
            raise ValueError(f"no accepted state at {path}")
        return cls(spark, path, number, document)

    def _name(self, table: str) -> str:
        """The catalogue name of a table of this generation; made known to the session when first used."""
        name = f"postmill_{table}_{self.document['generation']}"
        if name not in self._known:
            columns, key = self.TABLES[table]
            by = ", ".join(key)
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {name} ({columns}, append string) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
                f"INTO {self.buckets} BUCKETS LOCATION '{self.path}/{self.document['generation']}/{table}'"
            )
            self._known[name] = True
        return name

    def table(self, table: str, before: int | None = None) -> DataFrame:
        """The rows of a table that count, of batches before a number if one is given."""
        rows = self.spark.table(self._name(table)).where(F.col("append").isin(self.document["appends"] or [""])).drop("append")
        return rows if before is None else rows.where(F.col("batch_no") < before)

    def _append(self, frames: dict[str, DataFrame], append: str) -> None:
        def write(table: str, df: DataFrame) -> None:
            columns, key = self.TABLES[table]
            names = [c.split()[0] for c in columns.split(", ")]
            df.select(*names, F.lit(append).alias("append")).repartition(self.buckets, *key).write.insertInto(self._name(table))

        for table in frames:
            self._name(table)  # made known once, before the writers need it
        _together(*[lambda t=t, df=df: write(t, df) for t, df in frames.items()])

    def accept(self, contents: DataFrame, number: int) -> None:
        """Append the contents ``h, g, board, place, words, batch_no, seq`` of a batch; once for each batch."""
        if number in self.document["batches"]:
            return
        append = uuid.uuid4().hex
        seen = contents.select(F.explode(_paragraphs()["ph"]).alias("ph")).distinct()
        seen = seen.join(self.table("paragraphs"), "ph", "left_anti") if self.document["appends"] else seen
        parts = contents.select(F.explode(_all_but_one(stored=True)).alias("p"), "batch_no", "seq").select("p.*", "batch_no", "seq")
        self._append({"full": contents, "paragraphs": seen, "parts": parts}, append)
        self._publish(self.document | {"appends": [*self.document["appends"], append], "batches": [*self.document["batches"], number]})
        if len(self.document["appends"]) > COMPACT_AFTER:
            self.compact()

    def _publish(self, document: dict) -> None:
        pointers = Pointers(self.spark, self.path)
        self.number = pointers.publish(document, self.number)
        self.document = document
        pointers.forget(self.number - 1)

    def compact(self) -> None:
        """Write the tables anew as one append, and delete the old ones once they are named no more."""
        old, append = self.document["generation"], uuid.uuid4().hex
        frames = {t: self.table(t) for t in self.TABLES}
        names = list(self._known)
        self.document = self.document | {"generation": uuid.uuid4().hex}
        self._append(frames, append)
        self._publish(self.document | {"appends": [append]})
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        Pointers(self.spark, self.path).remove(old)

    def drop(self) -> None:
        """Forget the state and delete its files."""
        for name in self._known:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        Pointers(self.spark, self.path).remove("")


def _paragraphs() -> Column:
    """Of ``words``: each distinct word with its hash beside board and place."""
    return F.expr("transform(array_distinct(words), w -> struct(w as w, xxhash64('one', board, place, w) as ph))")


def _all_but_one(stored: bool) -> Column:
    """Of ``words``: each word that may be mistyped, with hashes of the rest and of a piece of the word.

    One slip in a word leaves its front or its back whole: of a word of ``n`` letters the first or the
    last ``(n - 1) / 2``, wherever it is. The piece is part of the hash, so records that differ in one
    word only, however many, don't all meet. A stored word has the two pieces that fit its own length; a
    word that asks has those for partners as long and a letter shorter or longer.
    """
    reach = [f"cast(greatest(floor((length(x.word) - 1 + {more}) / 2), 0) as int)" for more in ([0] if stored else [-1, 0, 1])]
    pieces = [f"concat('<', substring(x.word, 1, {n})), concat('>', substring(x.word, length(x.word) - {n} + 1, {n}))" for n in reach]
    of = lambda seed: f"xxhash64('{seed}', board, place, x.rest, piece)"
    rest = "array_join(concat(slice(words, 1, i), slice(words, i + 2, size(words))), ' ')"
    words = f"filter(transform(words, (w, i) -> struct({rest} as rest, w as word)), x -> length(x.word) >= 2 and not x.word rlike r'{_NUMERALS}')"
    return F.expr(f"flatten(transform({words}, x -> transform(array_distinct(array({', '.join(pieces)})), piece -> struct({of('part')} as lh, {of('again')} as lg, x.word as word))))")


def _asking(contents: DataFrame) -> DataFrame:
    """``h, g, lh, lg, word`` of contents: what a record with one mistyped spot would be found by."""
    return contents.select("h", "g", "batch_no", "seq", F.explode(_all_but_one(stored=False)).alias("p")).select("h", "g", "batch_no", "seq", "p.*")


def _covered(contents: DataFrame, held: DataFrame) -> DataFrame:
    """Contents of which at most one paragraph is in no accepted record, and which one that is.

    One mistyped spot leaves all other paragraphs as they were, so with two that nothing accepted has
    a record can't repeat one. Only the word that is missing, where there is one, can be the mistyped one.
    """
    asked = contents.select("h", "g", F.explode(_paragraphs()).alias("p")).select("h", "g", "p.w", "p.ph")
    missing = asked.join(held, "ph", "left_anti").groupBy("h", "g").agg(F.count("*").alias("n"), F.min("w").alias("missing"))
    return contents.join(missing, ["h", "g"], "left").where("n is null or n = 1").drop("n")


def _in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of links in the order of their later ends: the contents that an earlier one owns that isn't owned itself."""
    owned: set[int] = set()
    for pdf in batches:
        out = []
        for early, late in zip(pdf["early"].tolist(), pdf["late"].tolist()):
            if early not in owned and late not in owned:
                owned.add(late)
                out.append(late)
        yield pd.DataFrame({"late": out})


def _owned_within(edges: DataFrame) -> DataFrame:
    """Which contents of a batch another one of it owns: ``early, late``, by their numbers.

    ``edges`` link a content to each later one that would repeat it. While there are more than
    ``ORDERED_LINKS``, contents that no earlier one can own are settled together, with all they own;
    the rest is worked off in order by one task.
    """
    settled, left = [], edges
    while left.limit(ORDERED_LINKS + 1).count() > ORDERED_LINKS:
        first = left.join(left.select(F.col("late").alias("early")).distinct(), "early", "left_anti")
        gone = cut(first.select("late").distinct())
        settled.append(gone)
        left = cut(left.join(gone, "late", "left_anti").join(gone.withColumnRenamed("late", "early"), "early", "left_anti"))
    rest = left.coalesce(1).sortWithinPartitions("late", "early").mapInPandas(_in_order, "late bigint")
    owned = cut(reduce(DataFrame.unionByName, settled, rest))
    kept = edges.join(owned, "late").join(owned.withColumnRenamed("late", "early"), "early", "left_anti")
    return kept.groupBy("late").agg(F.min("early").alias("early"))


def dedup_batch(state: AcceptedState, rows: DataFrame, number: int) -> DataFrame:
    """Cases of one batch: ``seq_a`` (accepted) and ``seq_b``; the rest is accepted into ``state``.

    Only what was accepted in batches before ``number`` counts, so a batch that is run again after a
    crash gives the same cases, and is accepted once.

    ``rows`` has ``h, g, board, place, words, batch_no, seq``; a null ``h`` (no place that could be the
    same) is never a case and need not be kept. Equal contents of the batch are reduced to their
    first row before anything is joined, so a content delivered very often is one row here.
    """
    keyed = rows.where("h is not null")
    contents = cut(_contents(keyed))
    slip = one_slip("word", "other")
    own = F.struct("batch_no", "seq")
    same = contents.select("h", "g").join(state.table("full", number), ["h", "g"]).select("h", "g", own.alias("owner"))
    likely = _covered(contents, state.table("paragraphs"))
    asking = likely.select("h", "g", "missing", F.explode(_all_but_one(stored=False)).alias("p")).select("h", "g", "missing", "p.*").where("missing is null or word = missing")
    held = state.table("parts", number).withColumnRenamed("word", "other")
    near = asking.join(held, ["lh", "lg"]).where(slip).select("h", "g", own.alias("owner"))
    owners = same.unionByName(near).groupBy("h", "g").agg(F.min("owner.seq").alias("owner")) if state.document["appends"] else contents.select("h", "g", F.col("seq").alias("owner")).limit(0)
    # Contents of this batch that are one slip apart: an earlier one that is accepted owns a later one.
    early = contents.select(F.explode(_all_but_one(stored=True)).alias("p"), F.col("seq").alias("early")).select("p.lh", "p.lg", F.col("p.word").alias("other"), "early")
    edges = _asking(contents).join(early, ["lh", "lg"]).where((F.col("early") < F.col("seq")) & slip).select("early", F.col("seq").alias("late")).distinct()
    owners, edges = _together(lambda: cut(owners), lambda: cut(edges))
    fresh = contents.join(owners.select("h", "g"), ["h", "g"], "left_anti")
    known = contents.join(owners.select("h", "g"), ["h", "g"], "left_semi").select("seq")
    edges = edges.join(known.withColumnRenamed("seq", "late"), "late", "left_anti").join(known.withColumnRenamed("seq", "early"), "early", "left_anti")
    inner = _owned_within(edges)
    accepted = cut(fresh.join(inner.select(F.col("late").alias("seq")), "seq", "left_anti"))
    inner = contents.select("h", "g", F.col("seq").alias("late")).join(inner, "late").select("h", "g", F.col("early").alias("owner"))
    owner_of = owners.unionByName(inner).unionByName(accepted.select("h", "g", F.col("seq").alias("owner")))
    cases = keyed.select("h", "g", "seq").join(owner_of, ["h", "g"]).where("seq <> owner").select(F.col("owner").alias("seq_a"), F.col("seq").alias("seq_b"))
    return _together(lambda: cut(cases), lambda: state.accept(accepted, number))[0]


def _contents(keyed: DataFrame) -> DataFrame:
    """The first row of each content. Numbers are unique, so they alone order the rows of a batch."""
    row = F.struct("batch_no", "seq", "board", "place", "words")
    return keyed.groupBy("h", "g").agg(F.min_by(row, F.struct("batch_no", "seq")).alias("r")).select("h", "g", "r.*")


def history_rows(df: DataFrame, place: Column, shortenings: dict[str, str] = SHORTENINGS) -> DataFrame:
    """The rows of batches with the hashes of their content; ``place`` is null where none can be the same."""
    rows = df.where("batch_no is not null and seq is not null").select(
        F.col("batch_no").cast("int").alias("batch_no"), F.col("seq").cast("bigint").alias("seq"), F.col("board").cast("string").alias("board"),
        place.cast("string").alias("place"), role_parts(F.col("title"), shortenings).alias("words"),
    )
    known = F.col("board").isNotNull() & F.col("place").isNotNull() & (F.size("words") > 0)
    of = lambda seed: F.when(known, F.xxhash64(F.lit(seed), "board", "place", F.array_join("words", " ")))
    return rows.withColumns({"h": of("all"), "g": of("again")})


def dedup_history(rows: DataFrame, state: AcceptedState | None = None) -> tuple[DataFrame, AcceptedState]:
    """All batches in order against what was accepted before them; the cases and the state to carry on.

    Batch 0 is accepted history: all its rows are accepted, and of equal contents in it the first owns
    later cases. Defined results: rows with a null batch or number are left out; a null board or title,
    or a place that names none, never repeats anything; an empty table gives no cases. The rows are
    written by batch first, so that each batch reads its own rows only.
    """
    spark = rows.sparkSession
    state = state or AcceptedState.create(spark)
    folder = f"{state.path}/batches-{uuid.uuid4().hex}"
    rows.where("h is not null").write.partitionBy("batch_no").parquet(folder)
    rows = spark.read.schema(rows.schema).parquet(folder)
    numbers = sorted(r[0] for r in rows.select("batch_no").distinct().collect())
    cases = []
    for number in numbers:
        batch = rows.where(F.col("batch_no") == number)
        if number == 0:
            state.accept(cut(_contents(batch)), number)
        else:
            cases.append(dedup_batch(state, batch, number))
    Pointers(spark, state.path).remove(folder.rsplit("/", 1)[1])
    none = spark.createDataFrame([], "seq_a bigint, seq_b bigint")
    return reduce(DataFrame.unionByName, cases, none), state
