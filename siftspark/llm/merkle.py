"""Document fingerprints: Merkle trees over sections, paragraphs and sentences, in native expressions.

A text's lines are its paragraphs, eight of them a section; a paragraph's leaves are its
sentences, of at most some 80 characters. A node's hash covers its children's, so equal
roots mean equal texts, and where roots differ the differing branches lead to the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftspark.llm.common import let

#: Paragraphs of a section; a leaf: characters up to a mark that ends a sentence or table cell, with the marks.
SECTION, LEAF = 8, r"[^.!?|]{1,80}[.!?|]*|[.!?|]+"
#: Rows of a block of neighbours in id order, and blocks at most.
BLOCK, MOST_BLOCKS = 500, 65_536


def tree(text: Column) -> Column:
    """struct<root, sections: array<string>, paragraphs: array<string>, leaves: array<array<string>>> of a text.

    A leaf is 16 digits of its md5, a colon and its length in characters, so leaves carry
    their weight; hashes of paragraphs, sections and the root are whole md5s.
    """
    leaves = F.transform(F.split(text, "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.concat(F.substring(F.md5(x), 1, 16), F.lit(":"), F.length(x).cast("string"))))

    def from_leaves(found: Column) -> Column:
        paragraphs = F.transform(found, lambda p: F.md5(F.array_join(p, ",")))

        def from_paragraphs(hashes: Column) -> Column:
            count = F.ceil(F.size(hashes) / SECTION).cast("int")
            sections = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.md5(F.array_join(F.slice(hashes, k * SECTION + 1, SECTION), ",")))
            return let(sections, lambda s: F.struct(F.md5(F.array_join(s, ",")).alias("root"), s.alias("sections"), hashes.alias("paragraphs"), found.alias("leaves")))

        return let(paragraphs, from_paragraphs)

    return let(leaves, from_leaves)


def _weight(leaves: Column) -> Column:
    return F.aggregate(leaves, F.lit(0).cast("long"), lambda s, x: s + F.substring_index(x, ":", -1).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: equal roots 1, else twice the characters of the distinct leaves that both trees hold over those of either."""
    one, other = (F.array_distinct(F.flatten(t["leaves"])) for t in (a, b))
    both = let(one, lambda x: let(other, lambda y: let(F.struct(_weight(F.array_intersect(x, y)).alias("common"), (_weight(x) + _weight(y)).alias("all")), lambda w: F.when(w["all"] > 0, 2.0 * w["common"] / w["all"]).otherwise(0.0))))
    return F.when(a["root"] == b["root"], F.lit(1.0)).otherwise(both)


def first_difference(a: Column, b: Column) -> Column:
    """The branch where two trees first differ, as struct<section, paragraph> counted from 0; null for equal roots."""
    first = lambda x, y: F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False).cast("int") - 1
    section = first(a["sections"], b["sections"])
    inside = lambda s: F.struct(s.alias("section"), (s * SECTION + first(F.slice(a["paragraphs"], s * SECTION + 1, SECTION), F.slice(b["paragraphs"], s * SECTION + 1, SECTION))).alias("paragraph"))
    return F.when(a["root"] == b["root"], F.lit(None)).otherwise(let(section, inside))


def blocks_in_order(rows: DataFrame, key: str, block: int = BLOCK) -> tuple[DataFrame, int]:
    """rows with a column block: the number of quantiles of key below it, so that blocks are in the keys' order; nulls: -1."""
    n = rows.count()
    count = max(1, min(MOST_BLOCKS, -(-n // block)))
    side = max(1, round(count**0.5))
    quantiles = rows.agg(F.percentile_approx(key, [(i + 1) / (side * side) for i in range(side * side - 1)] or [0.5], max(10_000, 20 * count)).alias("q")).first()["q"] or []
    bounds = sorted(set(quantiles))
    if not bounds:
        return rows.withColumn("block", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(F.lit(0))), 1
    groups = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    kind = rows.schema[key].dataType.simpleString()
    literal = lambda xs: F.array(*map(F.lit, xs)).cast(f"array<{kind}>")
    below = lambda xs: F.size(F.filter(xs, lambda b: b < F.col(key)))
    group = F.greatest(below(literal([g[0] for g in groups])) - 1, F.lit(0))
    inner = let(group, lambda g: g * side + below(F.get(F.array(*map(literal, groups)), g)))
    return rows.withColumn("block", F.when(F.col(key).isNull(), F.lit(-1)).otherwise(inner)), len(bounds) + 1


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, next): each row with the text of the next by descending id, after the last the first; null texts are empty.

    Null ids come last; equal ids are in the order of their texts' md5. Rows are dealt in
    blocks of neighbours, ordered within a block, and only a block's last row needs
    another block's first: one row of each block.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    placed, _ = blocks_in_order(rows, "id")
    order = Window.partitionBy("block").orderBy(F.col("id").desc_nulls_last(), F.md5("text"))
    inside = placed.select("block", "id", "text", F.lead("text").over(order).alias("after"), F.row_number().over(order).alias("place"))
    heads = inside.where("place = 1").select("block", "text")
    chain = Window.orderBy(F.col("block").desc())  # one row of each block: at most MOST_BLOCKS
    ids = heads.select("block")
    follows = ids.select("block", F.coalesce(F.lead("block").over(chain), F.first("block").over(chain)).alias("to"))
    entry = follows.join(heads.select(F.col("block").alias("to"), F.col("text").alias("head")), "to").select(F.col("block").alias("_b"), "head")
    return inside.join(entry, inside["block"] == entry["_b"], "left").select("id", "text", F.coalesce("after", "head").alias("next"))


def compare_with_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: int = 3) -> DataFrame:
    """Trees of each text, of its edited text and of the next one, compared.

    The edit replaces the last floor(n / share) characters by as many first ones of the
    next text, or all if it has fewer. Columns: id, n_chars, edited, own, other, after
    (trees). Empty texts have the tree of one empty paragraph, so all have equal roots.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / share).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut), F.substring("next", F.lit(1), cut))
    return rows.select("id", "n_chars", edited.alias("edited"), "text", "next").select("id", "n_chars", "edited", let(F.struct("text", "edited", "next"), lambda r: F.struct(tree(r["text"]).alias("own"), tree(r["edited"]).alias("other"), tree(r["next"]).alias("after"))).alias("trees"))
