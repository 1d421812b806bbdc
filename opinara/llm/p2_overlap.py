"""Same or near-same records across splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm import canon, setjoin
from opinara.plans.runtime import expand_links, join_with_hot

TAU = 0.75
MIN_WORDS = 12


def text_tokens(df: DataFrame):
    """Maker of the words of a text as it looks: case, accents, punctuation, spacing, tags and odd characters removed."""
    table = canon.look_alikes(df.sparkSession)
    return lambda: canon.folder(table).words


def split_overlap(df: DataFrame, rid: str = "row_no", text: str = "text", split: str = "split", train: str = "train", tau: float = TAU, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the records of the training split and of all others.

    members: rid, cls, role (1 train, 2 other), size; one row per record with at least min_words words.
    links: a, b, the pairs of classes, one of them in train and one outside, that are the same (a = b) or share at
    least tau of their distinct words.  Hashes of canonicalised records are joined: whole-record hashes for the same
    texts, hashes of the rarest words for near ones (see setjoin), which a full comparison confirms.
    Null and blank texts, and texts under min_words, take no part; a null split counts as outside train.
    """
    role = F.when(F.col(split) == train, 1).otherwise(2)
    members, links = setjoin.links(df, rid, text, role, text_tokens(df), tau, min_words, across=True, ring=False, refine=False)
    same = members.where("rid = cls and roles = 3").select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    return members, links.unionByName(same)


def overlap_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """row_no_a < row_no_b: every pair of records behind the links, one in train and one outside."""
    both = links.unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    side = lambda r: members.where(F.col("role") == r).select(F.col("cls").alias("grp"), "rid")
    pairs = expand_links(both, side(1), side(2), "rid")
    return pairs.select(F.least("item_a", "item_b").alias("row_no_a"), F.greatest("item_a", "item_b").alias("row_no_b"))


def overlap_classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """rid, cls, role, copies, links: every record that takes part, the least record of its class, and how many other classes across the splits it is near to.

    This and the links are the whole result without any expansion of copies into pairs; ``role`` is 1 in train and 2 outside, ``copies`` the records of the class, ``both`` tells that it
    stands on both sides.
    """
    degree = links.where("a <> b").select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    sized = degree.join(members.where("rid = cls").select("cls", F.col("n").alias("size_of_class")), "cls")
    told = join_with_hot(members.select("rid", "cls", "role", F.col("n").alias("copies"), (F.col("roles") == 3).alias("both")), sized, "cls", "size_of_class")
    return told.select("rid", "cls", "role", "copies", "both", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def overlap_report(df: DataFrame, members: DataFrame, links: DataFrame, rid: str = "row_no", split: str = "split", source: str = "source") -> DataFrame:
    """split, source, records, same, near: how many records outside train stand in train, the same or nearly the same.

    A record that is both counts as same. Records too short to be compared count in records only; splits and sources
    without a match are reported with 0, a null source is a source of its own.
    """
    ends = links.where("a = b").select(F.col("a").alias("cls"), F.lit(2).alias("kind")).unionByName(
        links.where("a <> b").select(F.explode(F.array("a", "b")).alias("cls"), F.lit(1).alias("kind"))
    )
    # a linked class outside train has a partner in train, as its own roles and the links say
    kinds = ends.groupBy("cls").agg(F.max("kind").alias("kind"))
    near = _train_partner(members, links)
    flags = kinds.join(near, "cls", "left").join(members.where("rid = cls").select("cls", F.col("n").alias("size_of_class")), "cls")
    told = join_with_hot(members.where("role = 2").select("rid", "cls"), flags, "cls", "size_of_class")
    hits = told.select("rid", F.when(F.col("kind") == 2, 2).when(F.col("partner"), 1).alias("kind"))
    rows = df.where((F.col(split) != "train") | F.col(split).isNull()).select(F.col(rid).cast("long").alias("rid"), F.col(split).alias("split"), F.col(source).alias("source"))
    return rows.join(hits, "rid", "left").groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("records"), F.count_if(F.col("kind") == 2).alias("same"), F.count_if(F.col("kind") == 1).alias("near")
    )


def _train_partner(members: DataFrame, links: DataFrame) -> DataFrame:
    """The classes with a linked class that has a training record."""
    train = members.where("role = 1").select("cls").distinct()
    ways = links.where("a <> b").select("a", "b").unionByName(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    return ways.join(train, ways["b"] == train["cls"]).select(ways["a"].alias("cls"), F.lit(True).alias("partner")).distinct()
