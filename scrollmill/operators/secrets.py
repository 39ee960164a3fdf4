"""Known values, their digests, and whatever of them is left in any table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.layers import Finder, Seeker, Sieve, bare, hashes, heads, heart, marks, once, shifts, unwrapped, windows
from ..functions.redaction import RULES, counts, digests, fragments, near
from ..streaming.store import scratch

#: So many values go to the tasks whole; more are met by their grams.
BLOCK = 2000
#: Bits for each value's gram in the bitmap that all tasks hold, and its most, 16 MB.
BITS, LOG2_BITS = 32, 27
PAGE = 1 << 15
#: So many rows of an Arrow batch are read at a time, and so many values.
PART, VALUES = 64, 1024
HEX = r"(?:(?<![0-9A-Za-z])|(?<=\\[ntr]))[0-9a-f]{6,128}(?![0-9A-Za-z])"


def load_known(spark: SparkSession, path: str) -> DataFrame:
    """(value): the lines of a file of known values, comments, blank lines and
    values under six characters left out, each once."""
    line = F.regexp_replace("value", r"\r$", "")
    return spark.read.text(path).select(line.alias("value")).where((F.length("value") >= 6) & ~F.ltrim("value").startswith("#")).distinct()


def _parts(batches, rows: int = PART):
    """Arrow batches in pieces of a few rows: only their texts are Python's at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _rewritten(rows: DataFrame, columns: list[str], rewrite) -> DataFrame:
    """``rows`` with texts rewritten in Arrow batches, other columns as they are."""
    places = [rows.columns.index(c) for c in columns]
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rows.schema)]

    def run(batches):
        change = rewrite()
        for batch in _parts(batches):
            made = list(batch.columns)
            for i in places:
                made[i] = pa.array([None if x is None else change(x) for x in made[i].to_pylist()], made[i].type)
            yield pa.RecordBatch.from_arrays(made, [f"c{i}" for i in range(len(made))])

    plain = rows.toDF(*(f.name for f in fields))
    return plain.mapInArrow(run, T.StructType(fields)).toDF(*rows.columns)


def _hearts(known: DataFrame) -> DataFrame:
    """(gram, size, value): each value without layers, under its gram's hash."""

    def run(batches):
        for batch in batches:
            values = sorted({bare(v) for v in batch.column(0).to_pylist()} - {""})
            grams = [heart(v)[1] for v in values]
            yield pa.RecordBatch.from_arrays([pa.array(hashes(grams).view("int64")), pa.array([len(g) for g in grams], pa.int32()), pa.array(values, pa.string())], ["gram", "size", "value"])

    # Short rows with much to do each: dealt to all cores, not packed by their bytes.
    dealt = known.repartition(2 * known.sparkSession.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, "gram long, size int, value string")


def _marks(hearts: DataFrame) -> DataFrame:
    """(gram, size): the mark of each window of the values, and its length."""

    def run(batches):
        for batch in _parts(batches, VALUES):
            cut = [(w, len(v), i) for v in batch.column(0).to_pylist() for i, w in enumerate(windows(v))]
            texts, n, at = zip(*cut, strict=True) if cut else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(marks(list(texts), np.array(n), np.array(at)).view("int64")), pa.array([len(w) for w in texts], pa.int32())], ["gram", "size"])

    return hearts.select("value").mapInArrow(run, "gram long, size int")


def _heads(hearts: DataFrame) -> tuple[int, np.ndarray]:
    """How the values' grams begin: 256 bytes, made by the tasks."""
    n = hearts.agg(F.min("size").alias("n")).first().n

    def run(batches):
        for batch in batches:
            bits = heads([heart(v)[1][:n] for v in batch.column(0).to_pylist()])[1]
            yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(bits.tolist(), pa.int32())], ["code", "bits"])

    bits = np.zeros(256, np.uint8)
    for r in hearts.select("value").mapInArrow(run, "code int, bits int").groupBy("code").agg(F.bit_or("bits").alias("bits")).collect():
        bits[r.code] = r.bits
    return min(8, n), bits


def _sieve(hearts: DataFrame, begins: tuple[int, np.ndarray] = (0, None)) -> Sieve:
    """The hashes as one bitmap of a bounded size, made by the tasks in pages."""
    about = hearts.agg(F.count("*").alias("n"), F.collect_set("size").alias("sizes")).first()
    log2 = min(LOG2_BITS, max(15, (BITS * about.n).bit_length()))
    places = hearts.select(F.explode(F.array(*(F.shiftrightunsigned("gram", s).bitwiseAND(F.lit((1 << log2) - 1)) for s in shifts(log2)))).alias("at"))
    bits = np.zeros(1 << log2 - 3, np.uint8)
    for r in places.groupBy(F.expr(f"at div {PAGE}").alias("page")).agg(F.expr(f"bitmap_construct_agg(at % {PAGE})").alias("bits")).collect():
        bits[r.page * PAGE // 8 : (r.page + 1) * PAGE // 8] = np.frombuffer(r.bits, np.uint8)[: PAGE // 8]
    return Sieve(bits, log2, set(about.sizes), begins)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as they are now, read back from the shared folder."""
    at = scratch(rows.sparkSession, name)
    rows.write.parquet(at)
    return rows.sparkSession.read.parquet(at)


def _few(values: DataFrame, block: int) -> list[str] | None:
    """The distinct values (value); None if they are more than ``block``."""
    own = [r.value for r in values.select("value").distinct().limit(block + 1).collect()]
    return own if len(own) <= block else None


class _Known:
    """Known values (value), worked out once: whole if they are ``block`` at most,
    else the table of their grams, and bitmaps of grams and windows on all tasks."""

    def __init__(self, known: DataFrame, block: int):
        self.block = block
        self.hearts = stored(_hearts(known.where("value is not null").select("value").distinct()), "hearts")
        self.own = _few(self.hearts, block)
        self.seeker = None
        if self.own is None:
            lengths = {r.n for r in self.hearts.select(F.length("value").alias("n")).distinct().collect()}
            self.seeker = known.sparkSession.sparkContext.broadcast(Seeker(_sieve(self.hearts, _heads(self.hearts)), _sieve(_marks(self.hearts)), lengths))

    def met(self, texts: DataFrame) -> DataFrame:
        """(row, value): values that stand in one of a row's texts, of (row, texts
        ...), and for each long fragment that no such value explains one value.

        Of all values that a text holds the same fragment of, one is enough: the
        others mask nothing else. So a row meets no more values than it holds
        stretches, however many values share a gram or a fragment.
        """
        seeker = self.seeker

        def sought(batches):
            for batch in _parts(batches):
                keys, found = [], []
                for key, *own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    new = {x for text in filter(None, own) for x in seeker.value(bare(text))}
                    keys += [key] * len(new)
                    found += new
                grams, lengths, runs = zip(*found, strict=True) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.int64()), pa.array(lengths, pa.int32()), pa.array(runs, pa.string())], ["row", "gram", "n", "run"])

        # Tables of all values are never gathered by the driver, whatever their files' size.
        hearts = self.hearts.hint("merge")
        runs = stored(texts.mapInArrow(sought, "row long, gram long, n int, run string").distinct(), "runs")
        judged = runs.join(hearts.select("value"), F.col("run") == F.col("value"), "left")
        whole = judged.where("value is not null").select("row", "value")
        rest = judged.where("value is null or n <> length(run)").drop("value")
        near = hearts.join(rest.select("gram").distinct().hint("merge"), "gram", "left_semi")
        pieces = near.select("value", F.length("value").alias("n"), F.explode(fragments(F.col("value"))).alias("piece")).groupBy("n", "piece").agg(F.min("value").alias("value"))
        shortest = F.expr("greatest(8, cast(ceil(n * 0.7D) as int))")
        held = rest.select("row", "n", F.explode(fragments(F.col("run"), 0, shortest)).alias("piece"))
        return whole.unionByName(held.join(pieces.hint("merge"), ["n", "piece"]).select("row", "value")).distinct()


def _found(rows: DataFrame, columns: list[str], known: _Known, each, added: list[str]) -> DataFrame:
    """``rows`` with ``each(text, finder)`` in place of the texts of ``columns`` and
    long columns ``added`` to them, which sum the rest of what ``each`` returns.

    Few values go to the tasks whole. Of many the tasks hold bitmaps, and the stretches
    that pass them meet the values by a join; the values met go to the tasks whole
    again if they are few, so that no text is shuffled, and by row if they are not.
    A row's finder is None if it has none.
    """
    fields = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(rows.schema)]
    out = T.StructType([*fields, *(T.StructField(a, T.LongType()) for a in added)])
    places = [rows.columns.index(c) for c in columns]
    plain, own = rows.toDF(*(f.name for f in fields)), known.own
    if own is None:
        # Texts of one key may be different ones: their values are looked for in all of them.
        row_key = F.xxhash64(*(f"c{i}" for i in places))
        met = stored(known.met(plain.select(row_key.alias("row"), *(f"c{i}" for i in places))), "met")
        own = _few(met, known.block)
        if own is None:
            sought = met.groupBy("row").agg(F.collect_set("value").alias("sought"))
            plain = plain.withColumn("row", row_key).join(sought.hint("shuffle_hash"), "row", "left").drop("row")

    def run(batches):
        every = Finder(own, plain=True) if own else None
        for batch in _parts(batches):
            made = list(batch.columns)
            finders = [None if v is None else Finder(v, plain=True) for v in made.pop().to_pylist()] if own is None else [every] * batch.num_rows
            sums = [[0] * batch.num_rows for _ in added]
            for i in places:
                texts = made[i].to_pylist()
                for j, text in enumerate(texts):
                    if text is not None:
                        texts[j], *more = each(text, finders[j])
                        for s, x in zip(sums, more, strict=True):
                            s[j] += x
                made[i] = pa.array(texts, made[i].type)
            yield pa.RecordBatch.from_arrays([*made, *(pa.array(s, pa.int64()) for s in sums)], [f.name for f in out])

    return plain.mapInArrow(run, out).toDF(*rows.columns, *added)


def prepared(known: DataFrame, block: int = BLOCK) -> _Known:
    """Known values (value) worked out once, for several calls of what takes them."""
    return _Known(known, block)


def mask_known(rows: DataFrame, columns: list[str], known: DataFrame | _Known, block: int = BLOCK, bits: str | None = None) -> DataFrame:
    """``rows`` with every known value (value) in ``columns`` masked, under any
    layers of encoding and inside longer words, and with their long fragments.

    All values are looked for at once, so a whole value goes before the fragments
    of any other. Neither a task nor the driver holds more than ``block`` values
    and those of one batch of rows. Null texts stay null, empty values are none.
    ``bits`` names a long column to add: 0 if no rule of redaction may match a text.
    """

    def each(text, finder):
        masked = finder.mask(text) if finder else text
        return (masked, near(masked)) if bits else (masked,)

    return _found(rows, columns, known if isinstance(known, _Known) else _Known(known, block), each, [bits] if bits else [])


def mask_digests(rows: DataFrame, key: str, text: str, known: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """``rows`` with standalone hexadecimal tokens of 6 to 128 digits masked that
    begin a digest of a known value (value), alone or with a line end.

    ``stored`` (digest) are digests of values that nobody keeps. ``key`` is unique.
    Distinct tokens meet the digests by their first six digits; only rows with a
    hit are rewritten.
    """
    made = known.select(F.explode(digests(F.col("value"))).alias("digest"))
    made = (made if stored is None else made.unionByName(stored.select("digest"))).distinct().withColumn("head", F.substring("digest", 1, 6))
    tokens = rows.where(F.col(text).rlike(HEX)).select(F.col(key).alias("own"), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(HEX), F.lit(0)))).alias("token"))
    each = tokens.select("token", F.substring("token", 1, 6).alias("head")).distinct()
    hit = each.join(made, "head").where(F.col("digest").startswith(F.col("token"))).select("token").distinct()
    found = tokens.join(hit, "token").groupBy("own").agg(F.collect_set("token").alias("hits"))
    whole = F.struct(F.regexp_extract_all(text, F.lit(HEX), F.lit(0)).alias("tokens"), F.split(text, HEX, -1).alias("between"))

    def put(x: Column) -> Column:
        shown = F.transform(x["tokens"], lambda t: F.when(F.array_contains("hits", t), "[REDACTED:known_hash]").otherwise(t))
        rest = F.zip_with(shown, F.slice(x["between"], 2, F.size(shown)), lambda a, b: F.concat(a, b))
        return F.array_join(F.concat(F.array(F.get(x["between"], F.lit(0))), rest), "")

    masked = F.when(F.col("hits").isNull(), F.col(text)).otherwise(F.get(F.transform(F.array(whole), put), F.lit(0)))
    return rows.join(found, F.col(key) == F.col("own"), "left").withColumn(text, masked).drop("own", "hits")


def strings_of(table: DataFrame) -> dict[str, Column]:
    """Every column that can hold text; nested ones as JSON, strings as they are."""
    out = {}
    for f in table.schema:
        name = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            out[f.name] = name
        elif isinstance(f.dataType, T.VariantType | T.StructType | T.ArrayType | T.MapType) and "string" in f.dataType.simpleString() + ("string" if isinstance(f.dataType, T.VariantType) else ""):
            out[f.name] = F.to_json(F.struct(name.alias("x")))
    return out


def leaks(tables: dict[str, DataFrame], known: DataFrame | _Known | None = None, kinds: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """(table, field, kind, texts, hits): what secret shapes and known values are
    left in any text column of the tables, layers of encoding taken off first.
    Shapes keep their doubled marks: an address has two slashes, a key its dashes.

    The check shares no step with the masking of shapes: it judges the peeled
    texts, so a secret that masking missed because of its encoding is found. Marks
    of masking are no leak. Columns are stacked, never joined; a table without
    text gives no row.
    """
    parts = []
    for name, table in tables.items():
        for field, c in strings_of(table).items():
            parts.append(table.select(F.lit(name).alias("table"), F.lit(field).alias("field"), c.alias("text")).where("text is not null and text <> ''"))
    spark = next(iter(tables.values())).sparkSession
    if not parts:
        return spark.createDataFrame([], "table string, field string, kind string, texts long, hits long")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionAll(p)
    kinds = kinds or [r[0] for r in RULES]
    known = known if known is None or isinstance(known, _Known) else _Known(known, block)

    def look(text, finder):
        found = [kind for _, _, kind in finder(text)] if finder else []
        return unwrapped(text), found.count("known"), found.count("known_part")

    values = [] if known is None else ["known", "known_part"]
    numbers = [f"n_{k}" for k in values]
    if known is None or known.own is not None:
        peeled = _rewritten(rows, ["text"], lambda: unwrapped) if known is None else _found(rows, ["text"], known, look, numbers)
        return _summed(_shapes(peeled.withColumn("n", F.lit(1)), ["table", "field", "n", *numbers], kinds), [*values, *kinds])
    # Of many values a text is peeled once for all shapes, and only one that windows of theirs pass is looked at again.
    judged = stored(_shapes(_judged(rows, known.seeker), ["table", "field", "suspect"], kinds), "judged")
    suspects = judged.where("suspect is not null").groupBy("table", "field", "suspect").agg(F.count("*").alias("n"))
    shapes = _summed(judged.select("table", "field", F.lit(1).alias("n"), *(f"n_{k}" for k in kinds)), kinds)
    return shapes.unionAll(_summed(_found(suspects, ["suspect"], known, look, numbers), values))


def _shapes(rows: DataFrame, kept: list[str], kinds: list[str]) -> DataFrame:
    """Columns ``kept`` and the counts of each kind in ``text``, lowered once, or
    guarded by the ``bits`` beside it."""
    if "bits" in rows.columns:
        return rows.select(*kept, *counts(F.col("text"), kinds, bits=F.col("bits")))
    return rows.withColumn("low", F.lower("text")).select(*kept, *counts(F.col("text"), kinds, F.col("low")))


def _judged(rows: DataFrame, seeker) -> DataFrame:
    """(table, field, text, bits, suspect): texts without layers if a shape may match,
    with the bits of those shapes, and as they were where windows of known values pass."""

    def run(batches):
        for batch in _parts(batches):
            texts = batch.column(2).to_pylist()
            shown = [unwrapped(t) for t in texts]
            suspects = [t if seeker.value(once(s)) else None for t, s in zip(texts, shown, strict=True)]
            bits = [near(s) for s in shown]
            shown = [s if b else None for s, b in zip(shown, bits, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shown, pa.string()), pa.array(bits, pa.int64()), pa.array(suspects, pa.string())], ["table", "field", "text", "bits", "suspect"])

    return rows.mapInArrow(run, "table string, field string, text string, bits long, suspect string")


def _summed(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """(table, field, kind, texts, hits) of rows that stand for ``n`` texts each,
    with the hits of each in ``n_<kind>``."""
    long = rows.select("table", "field", "n", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"n_{k}").alias("hits")) for k in kinds))).alias("x")).select("table", "field", "n", "x.*")
    return long.where("hits <> 0").groupBy("table", "field", "kind").agg(F.sum("n").cast("long").alias("texts"), F.sum(F.col("n") * F.col("hits")).alias("hits"))
