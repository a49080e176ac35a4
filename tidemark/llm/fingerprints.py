"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line, cut every 512 code points. Its 40-bit key is added to one cell in each of three sub-tables; a cell holds the
count, the sum of keys and the sum of check values. Two versions' cells are subtracted, so common paragraphs cancel, and peeling
recovers the differing keys: a cell whose sums are its count times one key and that key's check value gives the key up, which is
then taken out of its other cells. If cells are left over, the versions are sketched again over as many blocks of cells as their keys
need, and the keys of blocks that still fail once more, hashed anew. Counts are
signed multiplicities, so repeated paragraphs need no special case.

All of it is expressions over a row's arrays; text is shuffled once, to bring a document and the one after it together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

PARAGRAPH = r"[^\n]{1,512}"
SUBTABLES, WIDTH = 3, 8  # cells of a block: sub-tables x width; positions take 3 bits of a key's hash each
RETRIES = 8
PER_BLOCK = 8  # keys a block on average when an attempt is repeated
PER_BUCKET = 256  # documents ordered together, up to MAX_BUCKETS buckets
MAX_BUCKETS = 65536
LOWEST = -(2**63)
_REST = "array<struct<k:bigint,s:bigint>>"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def keys(text: Column) -> Column:
    """A text's paragraph keys in text order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p).bitwiseAND(F.lit(2**40 - 1)))


def _signed(column: str, sign: int) -> str:
    return f"transform({column}, x -> named_struct('k', x, 's', {sign}L))"


def _places(w: str) -> str:
    """Check value and cell of each sub-table, from a key's hash."""
    cells = ", ".join(f"'q{j}', cast({WIDTH * j} + (shiftright({w}, {3 * j}) & {WIDTH - 1}) as int)" for j in range(SUBTABLES))
    return f"'h', shiftright({w}, 40) & 16777215L, {cells}"


def _entries(rest: str, salt: str, blocks: str = "1") -> str:
    """Signed keys with check value, cells and block; every salt hashes anew."""
    hashed = f"transform({rest}, e -> named_struct('k', e.k, 's', e.s, 'w', xxhash64(e.k, {salt})))"
    return f"transform({hashed}, e -> named_struct('k', e.k, 's', e.s, 'at', pmod(shiftright(e.w, 9) & 1073741823L, {blocks}), {_places('e.w')}))"


def _sketch(entries: str) -> str:
    """Cells (c, k, h): sums of sign, signed key and signed check value."""
    add = "named_struct('c', t.c + e.s, 'k', t.k + e.s * e.k, 'h', t.h + e.s * e.h)"
    tables = [f"transform(sequence({WIDTH * j}, {WIDTH * j + WIDTH - 1}), i -> aggregate({entries}, named_struct('c', 0L, 'k', 0L, 'h', 0L), (t, e) -> if(e.q{j} = i, {add}, t)))"
              for j in range(SUBTABLES)]
    return f"concat({', '.join(tables)})"


def sketch(column: str) -> Column:
    """The cells of a column of keys: array of (c, k, h)."""
    return F.expr(_let(_entries(_signed(column, 1), "0"), "es", _sketch("es")))


def written(column: str) -> Column:
    """Cells as text: hexadecimal count, key sum and check sum, joined."""
    return F.lower(F.array_join(F.expr(f"transform({column}, z -> concat_ws(':', hex(z.c), hex(z.k), hex(z.h)))"), ","))


def _subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (p, q) -> named_struct('c', p.c - q.c, 'k', p.k - q.k, 'h', p.h - q.h))"


def _peel(cells: str, salt: str) -> str:
    """(ok, a, b): whether all cells came out empty, and how many paragraphs only the first and only the second version has."""
    w = f"xxhash64(z.k div z.c, {salt})"
    # Sub-tables take turns, so one step never recovers the same key from two cells; three steps without a key end the peeling.
    one_key = f"if(z.c = 0, false, if(z.k % z.c = 0 and z.k div z.c >= 0, (shiftright({w}, 40) & 16777215L) * z.c = z.h, false))"
    pure = (f"transform(transform(filter(slice(s.cells, cast({WIDTH} * (r % {SUBTABLES}) + 1 as int), {WIDTH}), z -> {one_key}), z -> named_struct('c', z.c, 'k', z.k, 'z', z.h, 'w', {w})), "
            f"z -> named_struct('c', z.c, 'k', z.k, 'z', z.z, {_places('z.w')}))")
    cleared = ("aggregate(ps, s.cells, (cs, p) -> transform(cs, (z, i) -> if(i = p.q0 or i = p.q1 or i = p.q2, named_struct('c', z.c - p.c, 'k', z.k - p.k, 'h', z.h - p.z), z)))")
    found = (f"named_struct('cells', {cleared}, 'a', s.a + aggregate(ps, 0L, (n, p) -> n + greatest(p.c, 0L)), "
             f"'b', s.b + aggregate(ps, 0L, (n, p) -> n + greatest(-p.c, 0L)), 'idle', 0)")
    step = _let(pure, "ps", f"if(size(ps) = 0, named_struct('cells', s.cells, 'a', s.a, 'b', s.b, 'idle', s.idle + 1), {found})")
    return (f"aggregate(sequence(0, {SUBTABLES * 12 - 1}), named_struct('cells', {cells}, 'a', 0L, 'b', 0L, 'idle', 0), (s, r) -> if(s.idle < {SUBTABLES}, {step}, s), "
            f"s -> named_struct('ok', not exists(s.cells, z -> z.c <> 0 or z.k <> 0 or z.h <> 0), 'a', s.a, 'b', s.b))")


def _retried(rest: str) -> str:
    """(a, b) of the signed keys, sketched over as many blocks as they need; the keys of blocks that can't be peeled try again, hashed anew.

    Both versions' keys enter a block's cells with opposite signs, which is their subtraction.
    """
    merged = "if(d.ok, named_struct('rest', t.rest, 'a', t.a + d.a, 'b', t.b + d.b), named_struct('rest', concat(t.rest, transform(part, e -> named_struct('k', e.k, 's', e.s))), 'a', t.a, 'b', t.b))"
    # Keys are put in the order of their blocks once; a block then is a slice.
    part = "transform(slice(es, starts[j] + 1, coalesce(get(starts, j + 1), size(es)) - starts[j]), x -> x.e)"
    block = _let(part, "part", _let(_peel(_sketch("part"), "turn"), "d", merged))
    empty = f"cast(array() as {_REST})"
    blocks = f"(size(u.rest) div {PER_BLOCK} + 1)"
    walked = f"aggregate(sequence(0, size(starts) - 1), named_struct('rest', {empty}, 'a', u.a, 'b', u.b), (t, j) -> {block})"
    starts = "filter(transform(es, (x, i) -> if(i = 0, 0, if(x.at <> get(es, i - 1).at, i, -1))), i -> i >= 0)"
    ordered = f"array_sort(transform({_entries('u.rest', 'turn', blocks)}, e -> named_struct('at', e.at, 'e', e)))"
    attempt = _let(ordered, "es", _let(starts, "starts", walked))
    # Keys that no hashing separated are counted without a sketch.
    net = "aggregate(filter(u.rest, e -> e.k = x), 0L, (n, e) -> n + e.s)"
    kinds = "array_distinct(transform(u.rest, e -> e.k))"
    last = f"named_struct('a', u.a + aggregate({kinds}, 0L, (m, x) -> m + greatest({net}, 0L)), 'b', u.b + aggregate({kinds}, 0L, (m, x) -> m + greatest(-{net}, 0L)))"
    return (f"aggregate(sequence(1, {RETRIES}), named_struct('rest', cast({rest} as {_REST}), 'a', 0L, 'b', 0L), "
            f"(u, turn) -> if(size(u.rest) = 0, u, {attempt}), u -> {last})")


def likeness(keys_a: str, cells_a: str, keys_b: str, cells_b: str) -> Column:
    """Common paragraphs over all paragraphs of two versions, repeats counted, from the recovered difference; two empty ones are alike."""
    first = _peel(_subtract(cells_a, cells_b), "0")
    again = _retried(f"concat({_signed(keys_a, 1)}, {_signed(keys_b, -1)})")
    difference = _let(first, "f", f"if(f.ok, named_struct('a', f.a, 'b', f.b), {again})")
    whole = f"(size({keys_a}) + d.b)"
    return F.expr(_let(difference, "d", f"if({whole} = 0, 1.0D, (size({keys_a}) - d.a) / cast({whole} as double))"))


def _constant(values: list[int]) -> Column:
    return F.from_json(F.lit(str(values)), "array<bigint>")  # folded once into an array


def _bucket(ident: Column, bounds: list[int]) -> Column:
    """How many of the falling bounds (2^n - 1 of them) are above the id, by halving."""
    if not bounds:
        return F.lit(0)
    table, half = _constant(bounds), (len(bounds) + 1) // 2
    steps = F.array(*[F.lit(half >> i) for i in range(half.bit_length())])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.element_at(table, low + step) > ident, low + step).otherwise(low))


def with_next(docs: DataFrame) -> DataFrame:
    """docs: (id long, text, ...) with `next_` columns of the next row in falling id order, after the last the first.

    Ranges of ids are ordered apart, with a copy of the next range's first row; rows of one id go by text. Null ids come last.
    """
    ident = F.coalesce("id", F.lit(LOWEST))
    rows = docs.count()
    buckets = 1
    while buckets * PER_BUCKET < rows and buckets < MAX_BUCKETS:
        buckets *= 2
    shares = [1 - i / buckets for i in range(1, buckets)]
    bounds = docs.select(F.percentile_approx(ident, shares, max(10_000, 4 * buckets))).first()[0] if buckets > 1 and rows else []
    bucket = _bucket(ident, bounds)
    firsts = {r[0]: r[1] for r in docs.groupBy(bucket.alias("b")).agg(F.max(ident)).collect()}  # a row a bucket
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}
    first = F.element_at(_constant([firsts.get(b, LOWEST) for b in range(buckets)]), F.col("__bucket") + 1)
    host = F.element_at(_constant([before.get(b, 0) for b in range(buckets)]), F.col("__bucket") + 1).cast("int")
    own = F.struct(F.col("__bucket").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(host.alias("bucket"), F.lit(1).alias("guest"))
    placed = docs.withColumn("__id", ident).withColumn("__bucket", bucket)
    placed = placed.withColumn("__at", F.explode(F.when(F.col("__id") == first, F.array(own, guest)).otherwise(F.array(own))))
    placed = placed.select(*docs.columns, "__id", F.col("__at.bucket").alias("__bucket"), F.col("__at.guest").alias("__guest"))
    window = W.partitionBy("__bucket").orderBy("__guest", F.col("__id").desc(), "text")
    names = [c for c in docs.columns if c != "id"]
    following = F.lead(F.struct(*names)).over(window)
    return placed.withColumn("__next", following).where("__guest = 0").select(*docs.columns, *[F.col("__next")[c].alias("next_" + c) for c in names])


def fingerprint(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, keys, cells, fingerprint), one row per input row. Null texts count as empty and have no keys."""
    rows = docs.select(F.col(id_column), keys(F.coalesce(F.col(text_column), F.lit(""))).alias("keys"))
    return rows.withColumn("cells", sketch("keys")).withColumn("fingerprint", written("cells"))


def with_edits(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text against its edited version and its successor: (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last half (rounded down) replaced by as many characters from the start of the next row by falling id.
    Null texts count as empty; a lone row follows itself; repeated rows and ids each keep a row, ordered by text; null ids come last; an
    empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    both = with_next(rows.withColumn("keys", keys(F.col("text"))))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = both.select("id", F.length("text").cast("long").alias("n_chars"), "keys", "next_keys", edited.alias("edited"))
    both = both.select("id", "n_chars", "keys", "next_keys", F.sha2("edited", 256).alias("edited_sha256"), keys(F.col("edited")).alias("edited_keys"))
    both = both.select("*", sketch("keys").alias("cells"), sketch("edited_keys").alias("edited_cells"), sketch("next_keys").alias("next_cells"))
    return both.select(F.col("id").alias(id_column), "n_chars", "edited_sha256", written("cells").alias("fingerprint"),
                       written("edited_cells").alias("edited_fingerprint"), likeness("keys", "cells", "edited_keys", "edited_cells").alias("near_edited"),
                       likeness("keys", "cells", "next_keys", "next_cells").alias("near_next"))
