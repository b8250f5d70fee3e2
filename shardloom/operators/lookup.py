"""Left lookups into tables of any size, whatever the key frequencies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from shardloom.session import ship, stage

HEAD_ROWS = 65_536  # most rows of a broadcast join
HEAD_BYTES = 16 << 20  # and most bytes, about: the driver builds several side by side
WIDE = 1_024  # a row of more bytes is looked up by a join however frequent it is
SALTS = 16
AT_ONCE = 1 << 18  # items that a task handles and hands back at a time: what they stand for may be far larger than a batch of them

#: What becomes of the values of each array: a type, and a function of the lengths of the arrays and all values one after another.
Made = tuple[DataType, Callable[[np.ndarray, pa.Array], pa.Array]]


def lookup(rows: DataFrame, on: list[str], table: DataFrame, salt: Column, head_rows: int = HEAD_ROWS) -> DataFrame:
    """Left join `rows` to `table`, whose columns are `on` (unique), values, and a flag `hot`.

    A table of at most head_rows rows and HEAD_BYTES is broadcast. For a larger one the keys of its `hot` rows are, and the
    caller sees to it that there can be at most head_rows of those: an item with at least a head_rows-th of all occurrences,
    or one of the first head_rows ranks. Rows with a hot key are dealt out to several tasks by `salt`, and only these rows of
    the table are copied. `rows` is evaluated once. Pass a stored table: it is read up to three times.
    """
    if _fits(table.drop("hot"), head_rows):
        return rows.join(F.broadcast(table.drop("hot")), on, "left")
    hot = table.filter("hot").select(*on, F.lit(True).alias("_hot"))
    spread = F.when(F.col("_hot"), _salt_of(salt)).otherwise(0)
    marked = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", spread).drop("_hot")
    salts = F.when(F.col("hot"), _all_salts()).otherwise(F.array(F.lit(0)))
    return marked.join(table.select("*", F.explode(salts).alias("_salt")).drop("hot"), [*on, "_salt"], "left").drop("_salt")


def attach(rows: DataFrame, on: list[str], table: DataFrame, salt: Column) -> DataFrame:
    """Left join to a table with one row per group, such as shards or runs, of which one may own most rows."""
    if _fits(table, HEAD_ROWS):
        return rows.join(F.broadcast(table), on, "left")
    copies = table.select("*", F.explode(_all_salts()).alias("_salt"))
    return rows.withColumn("_salt", _salt_of(salt)).join(copies, [*on, "_salt"], "left").drop("_salt")


def _salt_of(salt: Column) -> Column:
    return F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int")


def _all_salts() -> Column:
    return F.sequence(F.lit(0), F.lit(SALTS - 1))


def _width(table: DataFrame) -> Column:
    """About how many bytes a row takes, from the lengths of its texts and arrays."""
    size = F.lit(32)
    for field in table.schema:
        kind = field.dataType.typeName()
        measured = F.octet_length(field.name) if kind in ("string", "binary") else F.size(field.name) * 16 if kind == "array" else None
        size = size + 16 + (F.lit(0) if measured is None else F.coalesce(measured, F.lit(0)))
    return size.cast("bigint")


def _fits(table: DataFrame, most_rows: int) -> bool:
    n, size = table.limit(most_rows + 1).agg(F.count("*"), F.sum(_width(table))).first()
    return n <= most_rows and (size or 0) <= HEAD_BYTES


def hottest(counts: DataFrame, count: str = "n") -> Column:
    """Which rows of a stored table have the highest counts: fewer than HEAD_ROWS of them."""
    floor = counts.select(count).orderBy(F.desc(count)).limit(HEAD_ROWS).agg(F.coalesce(F.min(count), F.lit(0))).first()[0]
    return F.col(count) > floor


def map_items(
    rows: DataFrame,
    key: list[str],
    items: str,
    table: DataFrame,
    default: object,
    out: str,
    map_side_rows: int = HEAD_ROWS,
    made: Made | None = None,
) -> DataFrame:
    """Replace each item of an array by its value in `table(item, value, hot)`, or by `default`.

    The values of an array become what `made` says, one array if nothing.

    A table of at most map_side_rows rows and HEAD_BYTES goes to all tasks and the arrays stay where they are. From a larger
    one its `hot` rows do. Arrays are then stored as places in that head; the items it misses, once per array, are joined with
    the rest of the table and put into their places. So an item moves only if it is rare, and an array only if it has such items.
    """
    ship(__name__)
    value = table.schema["value"].dataType
    made = made or (ArrayType(value), _listed)
    if _fits(table.drop("hot"), map_side_rows):
        known, values = _columns(table, default)
        replace = _replacer(table, known, values, made)
        return rows.select(*key, replace(F.col(items)).alias(out))
    missing = F.lit(default).cast(value) if default != [] else F.array().cast(value)
    in_head = F.coalesce(F.col("hot"), F.lit(False)) & (_width(table.drop("hot")) <= WIDE)
    head = _columns(table.filter(in_head), default)
    code, fill = _coder(table, rows.schema[items].dataType, head[0]), _filler(table, head[1], made)
    coded = rows.select(*key, F.monotonically_increasing_id().alias("_row"), code(F.col(items)).alias("_coded"))
    coded = stage(coded.select(*key, "_row", "_coded.codes", "_coded.missed"), "coded")  # rows get their numbers once
    parts = coded.select("_row", F.posexplode("missed").alias("_pos", "item"))
    rest = table.filter(~in_head).select("item", "value", F.lit(True).alias("_known"))
    found = parts.join(rest, "item", "left").select("_row", "_pos", F.when(F.col("_known"), F.col("value")).otherwise(missing).alias("value"))
    found = found.repartition("_row").groupBy("_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "value"))), lambda e: e["value"]).alias("found"))
    whole = coded.filter(F.size("missed") == 0).withColumn("found", F.array().cast(ArrayType(value)))
    mixed = coded.filter(F.size("missed") > 0).join(found, "_row")
    return whole.unionByName(mixed).select(*key, fill(F.col("codes"), F.col("found")).alias(out))


def _columns(table: DataFrame, default: object) -> tuple[pa.Array, pa.Array]:
    """Items, and their values with the default behind them."""
    pairs = table.select("item", "value").toArrow().combine_chunks()
    known, values = (pa.concat_arrays(pairs[c].chunks) if pairs.num_rows else pa.array([], pairs[c].type) for c in ("item", "value"))
    return known, pa.concat_arrays([values, pa.array([default], values.type)])


def _row_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of lists, a null's being 0, and the number of each item's list."""
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lengths, np.repeat(np.arange(len(lengths)), lengths)


def _listed(lengths: np.ndarray, items: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32()), items)


def flattened(value: ArrayType) -> Made:
    """The values are arrays, and become one."""

    def put(lengths: np.ndarray, items: pa.Array) -> pa.Array:
        inner = np.concatenate(([0], np.cumsum(_row_of(items)[0])))
        return pa.ListArray.from_arrays(pa.array(inner[np.concatenate(([0], np.cumsum(lengths)))], pa.int32()), items.flatten())

    return value, put


def joined(by: str) -> Made:
    """The values are strings and are put together; empty ones leave nothing."""

    def put(lengths: np.ndarray, items: pa.Array) -> pa.Array:
        kept = pc.fill_null(pc.not_equal(items, ""), False).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(lengths)), lengths)
        return pc.binary_join(_listed(np.bincount(row[kept], minlength=len(lengths)), items.filter(pa.array(kept))), by)

    return StringType(), put


def _some(lists: pa.Array) -> Iterator[slice]:
    """Ranges of lists with about AT_ONCE items each."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    low = 0
    while low < len(lists):
        high = int(np.searchsorted(ends, (ends[low - 1] if low else 0) + AT_ONCE, "right"))
        yield slice(low, max(high, low + 1))
        low = max(high, low + 1)


def _replacer(table: DataFrame, known: pa.Array, values: pa.Array, made: Made):
    """An Arrow function from item arrays to what becomes of their values."""
    shared = table.sparkSession.sparkContext.broadcast((known, values))
    kind, put = made

    @F.arrow_udf(kind)
    def replace(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, values = shared.value
        for batch in batches:
            for some in _some(batch):
                flat = batch[some].flatten()
                places = pc.fill_null(pc.index_in(flat, value_set=known.cast(flat.type)), len(values) - 1)
                yield put(_row_of(batch[some])[0], values.take(places))

    return replace


def _coder(table: DataFrame, kind: DataType, known: pa.Array):
    """An Arrow function from item arrays to places in the head, -1, -2, ... standing for the items it misses, which come beside."""
    shared = table.sparkSession.sparkContext.broadcast(known)
    made = StructType([StructField("codes", ArrayType(IntegerType())), StructField("missed", kind)])

    @F.arrow_udf(made)
    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for some in _some(batch):
                yield _coded(batch[some], shared.value)

    return code


def _coded(lists: pa.Array, known: pa.Array) -> pa.Array:
    flat = lists.flatten()
    lengths, row = _row_of(lists)
    places = pc.index_in(flat, value_set=known.cast(flat.type))
    codes = pc.fill_null(places, len(known)).to_numpy().copy()  # a null has no value: the default behind the head
    lost = np.flatnonzero(pc.and_(places.is_null(), flat.is_valid()).to_numpy(zero_copy_only=False))
    names = flat.take(pa.array(lost)).dictionary_encode()
    kinds = max(len(names.dictionary), 1)
    pairs, at = np.unique(row[lost].astype(np.int64) * kinds + names.indices.to_numpy(), return_inverse=True)
    owner = pairs // kinds
    first = np.searchsorted(owner, np.arange(len(lengths)))
    codes[lost] = -1 - (at - first[row[lost]])
    missed = _listed(np.bincount(owner, minlength=len(lengths)), names.dictionary.take(pa.array(pairs % kinds)))
    return pa.StructArray.from_arrays([_listed(lengths, pa.array(codes)), missed], ["codes", "missed"])


def _filler(table: DataFrame, values: pa.Array, made: Made):
    """An Arrow function from codes, and the values of what the head missed, to what becomes of the values."""
    shared = table.sparkSession.sparkContext.broadcast(values)
    kind, put = made

    @F.arrow_udf(kind)
    def fill(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        values = shared.value
        for codes, found in batches:
            for some in _some(codes):
                places = codes[some].flatten().to_numpy().astype(np.int64)
                lengths, row = _row_of(codes[some])
                first = np.concatenate(([0], np.cumsum(_row_of(found[some])[0])[:-1]))
                lost = places < 0
                places[lost] = len(values) + first[row[lost]] - 1 - places[lost]
                yield put(lengths, pa.concat_arrays([values, found[some].flatten().cast(values.type)]).take(pa.array(places)))

    return fill
