"""Names, citations and evidence: joins by containment, priority and prefix."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import kept


#: Grams of names up to which they are broadcast; more are met by a join.
BROADCAST_GRAMS = 1_000_000


def _text_grams(sizes: list[int], wanted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(text, gram): the distinct grams of each text that are among the ``wanted``, all without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, grams = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                t = text.as_py()
                found = {t[i : i + size] for size in sizes for i in range(len(t) - size + 1)}
                found = found & wanted.value if wanted else found
                keys += [key] * len(found)
                grams += found
                if len(grams) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.string())], ["_text", "_gram"])
                    keys, grams = [], []
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.string())], ["_text", "_gram"])

    return run


def contains_join(texts: DataFrame, text: str, names: DataFrame, name: str, gram: int = 4) -> DataFrame:
    """Rows of ``texts`` and ``names`` where the text contains the name; null and empty names are in none.

    Texts give the hashes of themselves with those of their grams that some name has. A name is met by its rarest gram,
    counted over the texts, so names with a common beginning do not meet every text; a name with a gram that no text has
    meets none. The names met are gathered by text, and a text moves once to be searched for them. Names shorter than
    ``gram`` have grams of their own length. The grams' counts, and the number of names' grams, are taken when this is
    called.
    """
    t, n = F.col(text), F.col(name)
    keyed = names.where(F.length(n) > 0).select(n.alias("_name")).distinct()
    size = F.least(F.lit(gram), F.length("_name"))
    keyed = keyed.select("_name", size.alias("_size"), F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("_name") - size + 1), lambda i: F.substring("_name", i, size)))).alias("_gram"))
    every = keyed.select("_gram").distinct().limit(BROADCAST_GRAMS + 1).toArrow().column(0).to_pylist()
    wanted = texts.sparkSession.sparkContext.broadcast(frozenset(every)) if len(every) <= BROADCAST_GRAMS else None
    sizes = sorted({len(g) for g in every}) if wanted else list(range(1, gram + 1))
    found = texts.where(t.isNotNull()).select(F.xxhash64(t).alias("_text"), t.alias("_t")).mapInArrow(_text_grams(sizes, wanted), "_text long, _gram string")
    found = kept(found if wanted else found.join(keyed.select("_gram").distinct(), "_gram", "left_semi").select("_text", "_gram"))
    counts = found.groupBy("_gram").agg(F.count("*").alias("_n"))
    routed = keyed.join(counts, "_gram", "left").groupBy("_name").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_gram").alias("g"))).alias("r"))
    routed = routed.where("r.n > 0").select("_name", F.col("r.g").alias("_gram"))
    met = found.join(routed, "_gram").groupBy("_text").agg(F.collect_set("_name").alias("_names"))
    rows = texts.withColumn("_text", F.xxhash64(t)).join(met, "_text").drop("_text")
    pairs = rows.withColumn("_name", F.explode(F.filter("_names", lambda x: F.contains(t, x)))).drop("_names")
    return pairs.join(names.where(F.length(n) > 0), F.col("_name") == n).drop("_name")


def pick_names(names: DataFrame, candidates: DataFrame, name: str = "name", candidate: str = "candidate", key=lambda c: c) -> DataFrame:
    """One candidate for each name: equal after ``key``, else the shortest that contains the name but no longer sibling that does."""
    n = names.select(name).distinct().withColumn("_n", key(F.col(name)))
    c = candidates.select(candidate).distinct().withColumn("_c", key(F.col(candidate)))
    met = contains_join(c, "_c", n, "_n")
    longer = met.select(F.col(candidate), F.col("_n").alias("_other"))
    shadowed = met.join(longer, candidate).where((F.length("_other") > F.length("_n")) & F.contains("_other", F.col("_n"))).select(name, candidate).distinct()
    left = met.where(F.col("_n") != F.col("_c")).join(shadowed, [name, candidate], "left_anti").unionByName(met.where(F.col("_n") == F.col("_c")))
    best = F.min_by(candidate, F.struct((F.col("_n") != F.col("_c")).alias("far"), F.length("_c").alias("n"), F.col(candidate).alias("c")))
    return left.groupBy(name).agg(best.alias(candidate))


def first_existing(refs: DataFrame, ref: str, keys: Column, corpus: DataFrame, key: str, value: str) -> DataFrame:
    """For each reference the value of the first of its candidate keys that exists, with the key's place; null if none does."""
    tried = refs.select("*", F.posexplode(keys).alias("_pos", "_key"))
    found = tried.join(corpus.select(F.col(key).alias("_key"), F.col(value).alias("_value")), "_key")
    first = found.groupBy(ref).agg(F.min_by(F.struct(F.col("_pos").cast("long").alias("place"), F.col("_value").alias(value)), F.struct("_pos", "_value")).alias("_f"))
    return refs.join(first, ref, "left").select(*refs.columns, "_f.place", f"_f.{value}")


def exact_else_prefix(refs: DataFrame, ref: str, corpus: DataFrame, key: str) -> DataFrame:
    """(ref, key, how): equal keys; for references without one, all keys that begin with them."""
    r, k = refs.select(F.col(ref).alias("ref")).distinct(), corpus.select(F.col(key).alias("key")).distinct()
    exact = r.join(k, F.col("ref") == F.col("key")).withColumn("how", F.lit("exact"))
    rest = r.join(exact.select("ref"), "ref", "left_anti")
    lengths = rest.select(F.length("ref").alias("_n")).distinct()
    cut = k.crossJoin(F.broadcast(lengths)).withColumn("_start", F.substring(F.col("key"), F.lit(1), F.col("_n")))
    prefix = rest.join(cut.drop("_n"), F.col("ref") == F.col("_start")).select("ref", "key", F.lit("prefix").alias("how"))
    return exact.select("ref", "key", "how").union(prefix)


def longest_alias(rows: DataFrame, text: str, aliases: list[tuple[str, str]], out: str = "canonical") -> DataFrame:
    """The name that the longest alias at the text's start stands for. The alias list is a constant, longest first."""
    best = F.lit(None).cast("string")
    for alias, name in sorted(aliases, key=lambda a: (len(a[0]), a[0])):
        best = F.when(F.startswith(F.col(text), F.lit(alias)), F.lit(name)).otherwise(best)
    return rows.withColumn(out, best)


def gathered(links: DataFrame, owner: str, order: str, fields: list[str], out: str = "evidence", most: int = 20) -> DataFrame:
    """The first ``most`` linked rows of each owner as an ordered array of structs; the cut is made before gathering."""
    w = Window.partitionBy(owner).orderBy(order)
    top = links.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return top.groupBy(owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*fields).alias("v")))), lambda x: x["v"]).alias(out))


def matched_rules(rules: DataFrame, rule: str, basis: str, refs: str, articles: DataFrame) -> DataFrame:
    """(…, outcome, n_refs, n_hits) of rules with their parsed references, an array of (name, candidate keys).

    Candidates are tried in order by an equi join with ``articles`` (name, key); a reference without keys needs the name
    alone. Outcome: ``manual`` without a basis, ``unparsed`` without a reference, else ``all``, ``some`` or ``none`` found.
    """
    each = rules.select(rule, F.posexplode(refs).alias("_at", "_r"))
    keys = F.when(F.col("_r.keys").isNull(), F.array(F.lit("*"))).otherwise(F.col("_r.keys"))
    tried = each.select(rule, "_at", F.col("_r.name").alias("_name"), F.explode(keys).alias("_key"))
    known = articles.select("name", "key").union(articles.select("name", F.lit("*"))).distinct().toDF("_name", "_key")
    hits = tried.join(known, ["_name", "_key"], "left_semi").groupBy(rule).agg(F.count_distinct("_at").alias("n_hits"))
    rows = rules.join(hits, rule, "left").withColumns({"n_refs": F.size(refs).cast("long"), "n_hits": F.coalesce("n_hits", F.lit(0))})
    outcome = F.when(F.coalesce(F.trim(basis), F.lit("")).isin("", "-"), "manual").when(F.col("n_refs") == 0, "unparsed").when(F.col("n_hits") == F.col("n_refs"), "all").when(F.col("n_hits") > 0, "some")
    return rows.withColumn("outcome", outcome.otherwise("none"))


def link_with_guard(rows: DataFrame, targets: DataFrame, target: str, by: list[list[str]]) -> DataFrame:
    """(…, target, how): the first of the key lists ``by`` that leads to a target. The first lists take the least target; the
    last links only where its keys have exactly one."""
    out = rows.withColumns({target: F.lit(None).cast(dict(targets.dtypes)[target]), "how": F.lit(None).cast("long")})
    for i, keys in enumerate(by):
        found = targets.where(sum((F.col(k).isNull().cast("int") for k in keys), F.lit(0)) == 0).groupBy(*keys).agg(F.min(target).alias("_t"), F.count_distinct(target).alias("_n"))
        if i == len(by) - 1:
            found = found.where("_n = 1")
        out = out.join(found, keys, "left").withColumns({"how": F.coalesce("how", F.when(F.col("_t").isNotNull(), i)), target: F.coalesce(target, "_t")}).drop("_t", "_n")
    return out


def twins(files: DataFrame, name: str, extension: str, other: str) -> DataFrame:
    """Files of one extension with ``twin``: whether one of the same stem and the other extension is there."""
    stem, end = F.regexp_replace(name, r"\.[^.]*$", ""), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    there = files.where(end == other).select(stem.alias("_stem")).distinct().withColumn("twin", F.lit(True))
    return files.where(end == extension).withColumn("_stem", stem).join(there, "_stem", "left").withColumn("twin", F.coalesce("twin", F.lit(False))).drop("_stem")


def most_overlap(names: DataFrame, name: str, titles: DataFrame, title: str, tokens: str) -> DataFrame:
    """Of each name the title that shares most of its distinct ``tokens``, the least of equals; null if none shares any."""
    a = names.select(name, F.explode(F.array_distinct(tokens)).alias("_t"))
    b = titles.select(title, F.explode(F.array_distinct(tokens)).alias("_t"))
    scores = a.join(b, "_t").groupBy(name, title).agg(F.count("*").alias("_n"))
    best = scores.groupBy(name).agg(F.min_by(F.struct(title, "_n"), F.struct(-F.col("_n"), F.col(title))).alias("_b"))
    return names.select(name).distinct().join(best, name, "left").select(name, F.col(f"_b.{title}").alias(title), F.col("_b._n").alias("shared"))
