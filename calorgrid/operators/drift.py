"""Schemas that drift between the files of a feed.

One pass over the lines catalogues every file: its fields and how many values of which type each has. Per
feed, field and type ``lag`` over the files' order finds where a presence is interrupted; the islands are
the lifespans, and their starts and endings are the changes: a type that ends where another of the same
field starts is a retyping, a field that ends where another starts is a renaming if the records in both
files carry the same values under either name. Only for such fields are values read, in a second pass. The
renamings form the alias table from which the casts into one consistent table are generated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from calorgrid.runtime import broadcast_if_small, scratch, spread

#: JSON types by the first letters of a variant's schema; all others are numbers.
KINDS = {"VOI": "null", "STR": "string", "BOO": "boolean", "ARR": "array", "OBJ": "object"}


def _parsed(lines: DataFrame, payload: str, feed: str, file_id: str, **more: Column) -> DataFrame:
    """``__feed, __file, .., __v``: every line parsed; null if it is no JSON."""
    rows = lines.select(F.col(feed).alias("__feed"), F.col(file_id).alias("__file"), F.col(payload).alias("__p"), *[c.alias(k) for k, c in more.items()])
    return spread(rows, "__p", per_core=1).withColumn("__v", F.try_parse_json("__p")).drop("__p")


def field_types(lines: DataFrame, payload: str, feed: str, file_id: str) -> DataFrame:
    """``feed, file_id, field, jtype, n``: how many values of each JSON type (null for null) the file's valid lines have.

    A line is valid if it is one JSON object; others explode into nothing or into entries without a name.
    Counts are combined map-side.
    """
    each = "select l.__feed as feed, l.__file as file_id, e.key as field, substring(schema_of_variant(e.value), 1, 3) as kind from {rows} l, lateral variant_explode(l.__v) e where e.key is not null"
    n = lines.sparkSession.sql(each, rows=_parsed(lines, payload, feed, file_id)).groupBy("feed", "file_id", "field", "kind").agg(F.count("*").alias("n"))
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    jtype = F.nullif(F.coalesce(known[F.col("kind")], F.lit("number")), F.lit("null"))
    return n.groupBy("feed", "file_id", "field", jtype.alias("jtype")).agg(F.sum("n").alias("n"))


def catalogue(lines: DataFrame, types: DataFrame, feed: str, file_id: str, seq: str) -> DataFrame:
    """``feed, file_id, ordinal, prev_file, next_file, field, ftype``: each file's fields with the type of most non-null values (ties: by name; null where all are null)."""
    files = lines.select(F.col(feed).alias("feed"), F.col(file_id).alias("file_id"), F.col(seq).alias("seq")).distinct()
    order = W.partitionBy("feed").orderBy("seq", "file_id")  # the files of a feed
    files = files.withColumn("ordinal", F.row_number().over(order)).withColumn("prev_file", F.lag("file_id").over(order)).withColumn("next_file", F.lead("file_id").over(order))
    # negative counts put the most frequent first; a null type never wins against a type
    best = types.groupBy("feed", "file_id", "field").agg(F.min(F.when(F.col("jtype").isNotNull(), F.struct((-F.col("n")).alias("n"), F.col("jtype").alias("t")))).alias("b"))
    renamed = files.toDF("__f", "__i", "seq", "ordinal", "prev_file", "next_file")
    return best.join(renamed, best["feed"].eqNullSafe(renamed["__f"]) & (best["file_id"] == renamed["__i"])).select("feed", "file_id", "ordinal", "prev_file", "next_file", "field", F.col("b.t").alias("ftype"))


def lifespans(cat: DataFrame) -> DataFrame:
    """Islands of successive files in which a feed's field has one type, in order.

    Columns: ``feed, field, ftype, island, first_file, last_file, n_files, file_before, file_after,
    begins`` (the field is not in the file before, and there is one), ``type_before`` (of the lifespan that
    ends right before) and ``ends`` (the field is not in the file after, and there is one).
    """
    by = W.partitionBy("feed", "field", "ftype").orderBy("ordinal")
    fresh = F.coalesce(F.lag("ordinal").over(by) != F.col("ordinal") - 1, F.lit(True))
    rows = cat.withColumn("__n", fresh.cast("int")).withColumn("island", F.sum("__n").over(by))
    first, last = F.min_by("file_id", "ordinal"), F.max_by("file_id", "ordinal")
    spans = rows.groupBy("feed", "field", "ftype", "island").agg(
        F.min("ordinal").alias("__a"), F.max("ordinal").alias("__b"), first.alias("first_file"), last.alias("last_file"), F.count("*").alias("n_files"),
        F.min_by("prev_file", "ordinal").alias("file_before"), F.max_by("next_file", "ordinal").alias("file_after"),
    )
    chain = W.partitionBy("feed", "field").orderBy("__a")
    goes_on = F.coalesce(F.lag("__b").over(chain) == F.col("__a") - 1, F.lit(False))
    followed = F.coalesce(F.lead("__a").over(chain) == F.col("__b") + 1, F.lit(False))
    spans = spans.withColumn("type_before", F.when(goes_on, F.lag("ftype").over(chain))).withColumn("begins", F.col("file_before").isNotNull() & ~goes_on).withColumn("ends", F.col("file_after").isNotNull() & ~followed)
    return spans.drop("__a", "__b")


def _canonical(jtype: Column, text: Column) -> Column:
    """A value to compare: numbers and texts that read as a number alike, other values by type and content."""
    number = F.when(~jtype.isin("boolean", "array", "object"), text.try_cast("double"))
    return F.when(number.isNotNull() & ~F.isnan(number), F.concat(F.lit("n:"), number.cast("string"))).otherwise(F.concat(F.substring(jtype, 1, 1), F.lit(":"), text))


def renamings(lines: DataFrame, spans: DataFrame, payload: str, feed: str, file_id: str, key: str) -> DataFrame:
    """``feed, file_id, gone, new``: endings and starts at the same file whose shared records carry the same values.

    Records are matched by key; a value missing on one side says nothing. At least one record must agree
    and none disagree. Where several names fit, the pair with most agreeing records is taken, then by name;
    each name is used once. Only lines of files where one field ends and another starts are read again.
    """
    gone = spans.where("ends").select("feed", F.col("file_after").alias("at"), F.col("last_file").alias("src"), "field")
    new = spans.where("begins").select("feed", F.col("first_file").alias("at"), F.col("first_file").alias("src"), "field")
    both = gone.select("feed", "at").intersect(new.select("feed", "at")).toDF("__f", "__a")
    sides = gone.withColumn("side", F.lit("g")).unionByName(new.withColumn("side", F.lit("n")))
    sides = sides.join(both, sides["feed"].eqNullSafe(both["__f"]) & (sides["at"] == both["__a"]), "left_semi")
    sides = scratch(sides.select(F.col("feed").alias("__f"), "at", F.col("src").alias("__s"), F.col("field").alias("__n"), "side"))
    n_sides = sides.count()
    files = broadcast_if_small(sides.groupBy("__f", "__s").agg(F.collect_set("__n").alias("__wanted")), n_sides)  # a file's fields
    mine = lines.join(files, F.col(feed).eqNullSafe(F.col("__f")) & (F.col(file_id) == F.col("__s")))
    rows = _parsed(mine, payload, feed, file_id, __wanted=F.col("__wanted"))
    rows = rows.withColumn("__key", F.try_variant_get("__v", f"$.{key}", "string"))
    each = "select l.__feed as feed, l.__file as file_id, l.__key as key, e.key as field, substring(schema_of_variant(e.value), 1, 3) as kind, cast(e.value as string) as text from {rows} l, lateral variant_explode(l.__v) e where e.key is not null and array_contains(l.__wanted, e.key)"
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    entries = lines.sparkSession.sql(each, rows=rows).where("key is not null and text is not null")
    entries = entries.select("feed", "file_id", "key", "field", _canonical(F.coalesce(known[F.col("kind")], F.lit("number")), F.col("text")).alias("value"))
    wanted = broadcast_if_small(sides, n_sides)
    hit = entries.join(wanted, entries["feed"].eqNullSafe(wanted["__f"]) & (entries["file_id"] == wanted["__s"]) & (entries["field"] == wanted["__n"]))
    # repeated lines are folded; a record with contradicting values says nothing
    values = scratch(hit.groupBy("feed", "at", "side", "key", "field").agg(F.min("value").alias("v"), F.max("value").alias("w")).where("v = w").drop("w"))
    side = lambda tag: values.where(F.col("side") == tag).select(*[F.col(c).alias(f"{c}_{tag}") for c in ("feed", "at", "key", "field", "v")])
    g, n = side("g"), side("n")
    pairs = g.join(n, g["feed_g"].eqNullSafe(n["feed_n"]) & (g["at_g"] == n["at_n"]) & (g["key_g"] == n["key_n"]))
    same = pairs.groupBy(F.col("feed_g").alias("feed"), F.col("at_g").alias("file_id"), F.col("field_g").alias("gone"), F.col("field_n").alias("new")).agg(
        F.count(F.when(F.col("v_g") == F.col("v_n"), 1)).alias("eq"), F.count(F.when(F.col("v_g") != F.col("v_n"), 1)).alias("ne")
    )
    fit = same.where("eq > 0 and ne = 0")
    for a, b in (("gone", "new"), ("new", "gone")):
        fit = fit.withColumn("__r", F.row_number().over(W.partitionBy("feed", "file_id", a).orderBy(F.desc("eq"), b))).where("__r = 1").drop("__r")
    return fit.select("feed", "file_id", "gone", "new")


def changes(lines: DataFrame, *, payload: str, feed: str, file_id: str, seq: str, key: str) -> DataFrame:
    """``file_id, field_before, field_after, change_kind`` of every file against the one before it in its feed.

    Kinds: ``added`` (before ``''``), ``removed`` (after ``''``), ``renamed`` and ``retyped`` (names before and
    after; types are compared where both files have non-null values). Broken lines, null payloads and lines
    that are no object carry nothing; a file of such lines only still is a file. Repeated lines count like
    one; empty input gives no rows.
    """
    return history(lines, payload=payload, feed=feed, file_id=file_id, seq=seq, key=key)[0]


def history(lines: DataFrame, *, payload: str, feed: str, file_id: str, seq: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The :func:`changes`, the :func:`lifespans`, the alias table (``feed, file_id, gone, new``) and the :func:`field_types`."""
    types = scratch(field_types(lines, payload, feed, file_id))
    spans = scratch(lifespans(catalogue(lines, types, feed, file_id, seq)))
    alias = scratch(renamings(lines, spans, payload, feed, file_id, key))
    ended = spans.where("ends").select("feed", F.col("file_after").alias("file_id"), F.col("field").alias("gone"), F.col("ftype").alias("t0"))
    begun = spans.where("begins").select("feed", F.col("first_file").alias("file_id"), F.col("field").alias("new"), F.col("ftype").alias("t1"))
    lost = ended.join(alias, ended["feed"].eqNullSafe(alias["feed"]) & (ended["file_id"] == alias["file_id"]) & (ended["gone"] == alias["gone"]), "left").select(ended["feed"], ended["file_id"], ended["gone"], "t0", "new")
    came = begun.join(alias, begun["feed"].eqNullSafe(alias["feed"]) & (begun["file_id"] == alias["file_id"]) & (begun["new"] == alias["new"]), "left_anti")
    kinds = begun.select(F.col("feed").alias("__f"), F.col("file_id").alias("__i"), F.col("new").alias("__n"), "t1")
    moved = lost.where("new is not null").join(kinds, F.col("feed").eqNullSafe(F.col("__f")) & (F.col("file_id") == F.col("__i")) & (F.col("new") == F.col("__n")))
    row = lambda df, before, after, kind: df.select("file_id", before.alias("field_before"), after.alias("field_after"), F.lit(kind).alias("change_kind"))
    out = row(lost.where("new is null"), F.col("gone"), F.lit(""), "removed")
    out = out.unionByName(row(came, F.lit(""), F.col("new"), "added"))
    out = out.unionByName(row(moved, F.col("gone"), F.col("new"), "renamed"))
    out = out.unionByName(row(moved.where("t0 != t1"), F.col("gone"), F.col("new"), "retyped"))
    same = spans.where("type_before != ftype").withColumn("file_id", F.col("first_file"))
    return out.unionByName(row(same, F.col("field"), F.col("field"), "retyped")), spans, alias, types


#: Canonical fields that get a column of their own; what further fields hold stays together in one map column.
MAX_FIELDS = 2000


def canonical_names(spans: DataFrame, alias: DataFrame) -> DataFrame:
    """``field, canonical``: names joined by renamings share the one that most files use (ties: by name).

    Labels spread along the renamings until none changes; the tables have one row per name.
    """
    own = spans.groupBy("field").agg(F.sum("n_files").alias("n")).select("field", F.struct((-F.col("n")).alias("n"), F.col("field").alias("name")).alias("label"))
    edges = alias.select(F.col("gone").alias("a"), F.col("new").alias("b")).distinct()
    edges = scratch(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = scratch(own)
    while True:
        heard = edges.join(labels, edges["b"] == labels["field"]).groupBy("a").agg(F.min("label").alias("l"))
        new = scratch(labels.join(heard, labels["field"] == heard["a"], "left").select("field", F.least("label", F.coalesce("l", "label")).alias("label"), (F.col("l") < F.col("label")).alias("moved")))
        done = new.where("moved").isEmpty()
        labels = new.drop("moved")
        if done:
            return labels.select("field", F.col("label.name").alias("canonical"))


def consistent_table(lines: DataFrame, *, payload: str, feed: str, file_id: str, seq: str, key: str, keep: list[str], most: int = MAX_FIELDS) -> DataFrame:
    """All valid lines as one table: the columns ``keep`` and one column per canonical field, cast to its type.

    The casts are generated from the alias table: every name of a field is read, wrapped values
    (``{"value": x}`` and ``[x]``) are unwrapped, numbers and truth values are cast where the field's most
    frequent scalar type asks for it, else the text is kept; what cannot be cast is null. Where a line
    carries a field under two names the canonical one counts. A field's column that clashes with ``keep``
    gets the suffix ``_field``. The ``most`` canonical fields of most values get columns; if there are more,
    the values of the others come in the map ``more_fields`` under their own names.
    """
    _, spans, alias, types = history(lines, payload=payload, feed=feed, file_id=file_id, seq=seq, key=key)
    names = scratch(canonical_names(spans, alias))
    sizes = types.join(names, "field").groupBy("canonical").agg(F.sum("n").alias("n"))
    chosen = scratch(sizes.orderBy(F.desc("n"), "canonical").limit(most + 1))
    kept = [r["canonical"] for r in chosen.orderBy(F.desc("n"), "canonical").collect()]  # at most most + 1 names
    more, kept = len(kept) > most, kept[:most]
    named = names.where(F.col("canonical").isin(kept))
    typed = types.where("jtype in ('string', 'number', 'boolean')").join(named, "field").groupBy("canonical", "jtype").agg(F.sum("n").alias("n"))
    kinds = {r["canonical"]: r["t"] for r in typed.groupBy("canonical").agg(F.min_by("jtype", F.struct((-F.col("n")).alias("n"), "jtype")).alias("t")).collect()}
    aliases: dict[str, list[str]] = {c: [] for c in kept}
    for r in named.collect():  # the names of the fields that get columns
        aliases[r["canonical"]].append(r["field"])
    valid = F.try_parse_json(F.col(payload))
    rows = lines.where(valid.isNotNull() & F.schema_of_variant(valid).startswith("OBJECT"))
    rows = rows.withColumn("__m", F.from_json(payload, "map<string,string>"))
    taken = {c.lower() for c in keep}
    out = []
    for canonical in sorted(aliases):
        order = [canonical, *sorted(a for a in aliases[canonical] if a != canonical)]
        raw = F.coalesce(*[F.col("__m")[a] for a in order])
        bare = F.when(raw.startswith("{"), F.coalesce(F.get_json_object(raw, "$.value"), raw)).when(raw.startswith("["), F.coalesce(F.get_json_object(raw, "$[0]"), raw)).otherwise(raw)
        cast = {"number": "double", "boolean": "boolean"}.get(kinds.get(canonical))
        name = f"{canonical}_field" if canonical.lower() in taken else canonical
        out.append((bare.try_cast(cast) if cast else bare).alias(name))
    if more:
        own = F.array(*[F.lit(a) for names_of in aliases.values() for a in names_of])
        out.append(F.map_filter("__m", lambda k, _: ~F.array_contains(own, k)).alias("more_fields"))
    return rows.select(*keep, *out)
