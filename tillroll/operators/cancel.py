"""Cancelled purchases: matching them to earlier orders, census, netting.

A cancel is a line with ``Quantity <= 0`` that is not a discount. Its candidates are the
purchases of the same customer and stock code at strictly earlier times:

* none: the cancel is ``doubtful`` and leaves the table;
* exactly one: it is ``matched`` to that purchase, whatever the quantity;
* several: it is matched to the last one that is large enough; with none it stays
  (``remaining``) as a negative line.

The matched purchase gets ``QuantityCanceled``; of several cancels on one purchase the
last one counts.

Joining cancels with all their candidates would pair up whole groups of lines. Instead,
counts and the latest earlier purchase come from running aggregates, which settle nearly
all cancels. The rest ask for the last earlier purchase of at least q units: there each
purchase is entered under the groups its quantity is in (base-4 prefixes and digit
counts), and the quantities from q up are a union of a few such groups, so every group
again needs only its latest earlier entry. Entries are combined per timestamp first and
the running aggregates go per chunk of time and then over chunks, so no task holds more
than the timestamps of one chunk or the chunks of one key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tillroll.functions.time import to_micros, whole
from tillroll.schema import line_key
from tillroll.session import materialize

KEY = ["CustomerID", "StockCode"]
MICROS_PER_HOUR = 3_600_000_000
#: Words of 64 bits that mark the hashes of the keys with cancels: at most 16 MB, whatever the number of keys.
WORDS = 1 << 20


def is_discount() -> Column:
    return F.col("Description").eqNullSafe(F.lit("Discount"))


def is_cancel_line() -> Column:
    return (F.col("Quantity") <= 0) & ~is_discount()


def _prefix(digits_dropped: Column, head: Column) -> Column:
    """Number of a base-4 prefix; unique over all (dropped digits, head)."""
    return F.shiftleft(digits_dropped.cast("bigint"), 32) + head.cast("bigint")


def _at_least_digits(digits: Column) -> Column:
    """Number of the group of all quantities with at least so many base-4 digits."""
    return _prefix(digits + 64, F.lit(0))


def _digits(quantity: Column) -> Column:
    return F.floor((F.length(F.bin(quantity)) + 1) / 2).cast("int")


def _groups_of(quantity: Column) -> Column:
    """Every group a positive quantity is in: by digit count and by prefix."""
    counts = F.sequence(F.lit(1), _digits(quantity))
    return F.concat(
        F.transform(counts, _at_least_digits),
        F.transform(counts, lambda i: _prefix(
            i - 1, F.call_function("shiftright", quantity, 2 * (i - 1)))))


def _groups_from(quantity: Column) -> Column:
    """Disjoint groups that together hold every quantity of at least ``quantity``."""
    def larger_siblings(i: Column) -> Column:
        head = F.call_function("shiftright", quantity, 2 * (i - 1))
        digit = F.pmod(head, F.lit(4))
        steps = F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda e: digit + e <= 3)
        return F.transform(steps, lambda e: _prefix(i - 1, head + e))

    own = F.array(_at_least_digits(_digits(quantity) + 1), _prefix(F.lit(0), quantity))
    return F.concat(own, F.flatten(F.transform(F.sequence(F.lit(1), _digits(quantity)),
                                               larger_siblings)))


def _before(entries: DataFrame, probes: DataFrame, keys: list[str], chunk_hours: int) -> DataFrame:
    """Probes with ``n`` and ``last``: count and greatest line of the entries with the same
    keys and an earlier ``at``. ``entries``: keys, at, n, last; ``probes``: keys, at, need, ..."""
    micros = to_micros(F.col("at"))
    both = (entries.unionByName(probes, allowMissingColumns=True)
            .withColumn("chunk", F.coalesce(whole(micros, chunk_hours * MICROS_PER_HOUR), F.lit(0))))
    per_chunk = both.groupBy(*keys, "chunk").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    earlier_chunks = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.select(*keys, "chunk", F.sum("n").over(earlier_chunks).alias("n_carried"),
                               F.max("last").over(earlier_chunks).alias("last_carried"))
    earlier = (Window.partitionBy(*keys, "chunk").orderBy("micros")
               .rangeBetween(Window.unboundedPreceding, -1))
    inside = (both.withColumn("micros", micros)
              .select(*probes.columns, "chunk", F.sum("n").over(earlier).alias("n_inside"),
                      F.max("last").over(earlier).alias("last_inside"))
              .where("need is not null"))
    zero = F.lit(0).cast("bigint")
    return (inside.join(carried, [*keys, "chunk"])
            .select(*probes.columns,
                    (F.coalesce("n_inside", zero) + F.coalesce("n_carried", zero)).alias("n"),
                    F.greatest("last_inside", "last_carried").alias("last")))


def with_key_mark(lines: DataFrame) -> DataFrame:
    """Lines with ``maybe``: whether their key shares its hash with that of a cancel, as all keys with cancels do.

    The marks are a table of bounded size, the one that is always broadcast. Lines without mark have no part in
    the matching, so they need not be shuffled for it.
    """
    place = F.xxhash64(*KEY)
    word, bit = F.pmod(place, F.lit(WORDS)), F.call_function("shiftright", place, F.lit(58)).bitwiseAND(63)
    words = materialize(lines.where(is_cancel_line()).select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int")).alias("own"))
                        .groupBy("word").agg(F.bit_or("own").alias("bits")), "cancel-keys")
    held = F.call_function("shiftright", F.col("bits"), bit.cast("int")).bitwiseAND(1) == 1
    return (lines.withColumn("word", word).join(F.broadcast(words), "word", "left")
            .select(*lines.columns, F.coalesce(held, F.lit(False)).alias("maybe")))


def match_cancels(lines: DataFrame, chunk_hours: int = 1) -> DataFrame:
    """One row per distinct (customer, stock code, time, quantity) of the cancels.

    Columns: the key, ``at``, ``need`` (units given back), ``n_lines`` (cancel lines
    behind the row), ``n_candidates``, ``status`` and ``order_line``. ``lines`` must be
    free of duplicates and is read several times.
    """
    lines = lines.na.drop(subset=[*KEY, "InvoiceDate"])
    at, line = F.col("InvoiceDate").alias("at"), line_key(lines).alias("line")
    cancels = (lines.where(is_cancel_line())
               .groupBy(*KEY, at, (-F.col("Quantity").cast("bigint")).alias("need"))
               .agg(F.count("*").alias("n_lines")))
    purchases = with_key_mark(lines).where("Quantity > 0 and maybe")

    def latest(table: DataFrame, keys: list[str]) -> DataFrame:
        return table.groupBy(*keys, "at").agg(F.count("*").alias("n"), F.max("line").alias("last"))

    # stored: the second question is put to these alone, not to all purchases again
    entries = materialize(purchases.join(cancels.select(*KEY).distinct(), KEY, "left_semi")
                          .select(*KEY, at, line, "Quantity"), "purchases")
    seen = materialize(_before(latest(entries, KEY), cancels, KEY, chunk_hours), "cancels")

    too_small = (F.col("n") > 1) & (F.col("last.Quantity") < F.col("need"))
    open_cancels = seen.where(too_small)
    grouped = (entries.where("Quantity > 0").join(open_cancels.select(*KEY).distinct(), KEY, "left_semi")
               .select(*KEY, "at", "line", F.explode(_groups_of(F.col("Quantity"))).alias("units")))
    asked = open_cancels.select(*KEY, "at", "need", F.explode(_groups_from(F.col("need"))).alias("units"))
    larger = (_before(latest(grouped, [*KEY, "units"]), asked, [*KEY, "units"], chunk_hours)
              .groupBy(*KEY, "at", "need").agg(F.max("last").alias("larger")))
    order_line = F.when(too_small, F.col("larger")).otherwise(F.col("last"))
    return (seen.join(larger, [*KEY, "at", "need"], "left")
            .select(*KEY, "at", "need", "n_lines", F.col("n").alias("n_candidates"),
                    F.when(F.col("n") == 0, "doubtful").when(order_line.isNull(), "remaining")
                    .otherwise("matched").alias("status"),
                    order_line.alias("order_line")))


def _with_status(cancels: DataFrame, matches: DataFrame, how: str) -> DataFrame:
    found = matches.select(*KEY, F.col("at").alias("InvoiceDate"), "status", "n_candidates", "order_line",
                           (-F.col("need")).cast("int").alias("Quantity"))
    return (cancels.join(found, [*KEY, "InvoiceDate", "Quantity"], how)
            .select(*cancels.columns, "status", "n_candidates", "order_line"))


def cancel_lines(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Each cancel line with its status and, if matched, its order line."""
    return _with_status(lines.where(is_cancel_line()), matches, "inner")


def net_cancels(lines: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Lines that stay, with ``QuantityCanceled``.

    Cancels are joined with their matches once; those that stay are done with, and those that are matched mark their order.
    The marks are attached to the purchases by grouping over the whole line instead of a join:
    that takes one shuffle and leaves nothing to skew. Purchases whose key has no cancel stay where they are. Equal lines
    would fall together, so they are refused with an error.
    """
    matches = match_cancels(lines) if matches is None else matches
    columns = lines.columns
    cancel = F.coalesce(is_cancel_line(), F.lit(False))
    marked = with_key_mark(lines)
    equal = F.raise_error(F.lit("equal lines: remove duplicates before netting")).cast("int")
    ungrouped = marked.where(cancel | ~F.col("maybe")).select(*columns)
    # equal lines have equal hashes; where hashes repeat, the lines themselves are compared
    if not ungrouped.groupBy(F.xxhash64(*columns).alias("h")).count().where("count > 1").isEmpty():
        ungrouped = ungrouped.groupBy(*columns).agg(F.when(F.count("*") > 1, equal).otherwise(1).alias("own")).where("own = 1").drop("own")
    # stored without the doubtful ones: read for the lines that stay and for the marks
    open_or_ordered = F.col("status").isNull() | (F.col("status") == "remaining") | F.col("order_line").isNotNull()
    told = materialize(_with_status(ungrouped.where(cancel), matches, "left").where(open_or_ordered), "told")
    marks = (told.where("status <> 'remaining' and order_line is not null")
             .select("order_line", (-F.col("Quantity")).alias("units"), line_key(lines).alias("by"))
             .groupBy("order_line").agg(F.max_by("units", "by").alias("QuantityCanceled"))
             .select(*[F.col(f"order_line.{c}").alias(c) for c in columns], "QuantityCanceled"))
    purchases = marked.where(F.col("maybe") & ~cancel).select(*columns, F.lit(None).cast("int").alias("QuantityCanceled"), F.lit(1).alias("own"))
    netted = (purchases.unionByName(marks.withColumn("own", F.lit(0))).groupBy(*columns)
              .agg(F.when(F.sum("own") > 1, equal).otherwise(F.coalesce(F.max("QuantityCanceled"), F.lit(0))).alias("QuantityCanceled")))
    rest = ungrouped.where(~cancel).unionByName(told.where("status is null or status = 'remaining'").select(*columns))
    return netted.unionByName(rest.withColumn("QuantityCanceled", F.lit(0)))


def _cancels_with(lines: DataFrame, matches: DataFrame | None, status: str) -> DataFrame:
    matches = match_cancels(lines) if matches is None else matches
    return cancel_lines(lines, matches).where(F.col("status") == status).select(*lines.columns)


def matched_cancels(lines: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Cancel lines that found their order."""
    return _cancels_with(lines, matches, "matched")


def doubtful_cancels(lines: DataFrame, matches: DataFrame | None = None) -> DataFrame:
    """Cancel lines without any earlier purchase."""
    return _cancels_with(lines, matches, "doubtful")


def cancel_census(matches: DataFrame) -> DataFrame:
    return matches.groupBy("status").agg(F.sum("n_lines").alias("n"))


def remaining_returns(cleaned: DataFrame) -> DataFrame:
    """Negative lines left after netting; discounts (stock code D) are not counted."""
    return cleaned.where("Quantity < 0 and StockCode <> 'D'")


def lines_per_basket(lines: DataFrame) -> DataFrame:
    """Lines per (customer, invoice) and whether the invoice is a cancellation.

    The mark is a C anywhere in the number, not only in front.
    """
    return (lines.groupBy("CustomerID", "InvoiceNo").agg(F.count("InvoiceDate").alias("n_products"))
            .withColumn("order_canceled", F.col("InvoiceNo").contains("C").cast("int")))


def cancelled_orders(baskets: DataFrame) -> DataFrame:
    cancelled, total = F.sum("order_canceled"), F.count("*")
    return baskets.agg(cancelled.alias("canceled"), total.alias("orders"),
                       (cancelled * 100.0 / total).alias("rate_pct"))


def without_counterpart(lines: DataFrame, by: str = "Description",
                        skip_discounts: bool = False) -> DataFrame:
    """Returns for which no line has the same customer, opposite quantity and same ``by``.

    Opposites are made distinct before the anti join, so a hot key carries one row.
    """
    returns = lines.where("Quantity < 0")
    if skip_discounts:
        returns = returns.where(~is_discount())
    opposite = (lines.where("Quantity > 0")
                .select("CustomerID", (-F.col("Quantity")).alias("Quantity"), by).distinct())
    return returns.join(opposite, ["CustomerID", "Quantity", by], "left_anti").select(*lines.columns)


def first_without_counterpart(lines: DataFrame, by: str = "Description",
                              skip_discounts: bool = False) -> DataFrame:
    """The first such return in line order, if any."""
    broken = without_counterpart(lines, by, skip_discounts)
    return broken.orderBy(line_key(lines)).limit(1)
