"""URL patterns learned from the data: which path segments are parameters, and how many URLs each pattern has.

The prefix tree is a table of counted paths. A round counts the children of every
prefix at once and finds the prefixes that are open: those with so many children
that they must be values (or nearly as many children as URLs), and those with a
parameter beside names. An open prefix is decided when nothing below it is open,
so prefixes of all depths are decided in one round. Of its children, those that
look alike and are many become ``{param}``; their subtrees merge and are decided
in the next round. Only counts decide, so the order of the input doesn't.

What is learned is a table of rules (parent, literal): at a rewritten prefix that
has a rule, a segment is a value unless it is one of the literals there. A URL's
template follows from its own segments and the rules, so new URLs get theirs in
the same way.

Counted paths add up: those of several passes, kept as tables, are summed and
decided again without their URLs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pathsieve.functions.urls import PARAM, path_shape
from pathsieve.operators.upserts import checkpointed as _checkpoint
from pathsieve.operators.upserts import forget, small_partitions

#: Children from which a slot is a parameter, URLs that the ratio needs, and the ratio of children to URLs (fixed values).
MANY, OBSERVED, RATIO = 100, 30, 0.6
#: Children up to which a signature names them (fixed value).
NAMED = 8
#: Rows that are broadcast at most; a larger table is joined by a shuffle.
BROADCAST = 1 << 16
#: Rules that are written into a projection at most; more of them are joined depth by depth.
INLINE = 1 << 12
#: Separates the segments of a prefix; can't occur in a URL path.
SEP = "\n"


def path_counts(urls: DataFrame, segments: str = "segments") -> DataFrame:
    """(path, n): distinct segment paths and how many URLs have them."""
    return urls.groupBy(F.array_join(segments, SEP).alias("path")).agg(F.count("*").alias("n"))


def _looks_variable(children, observed):
    return (children > MANY) | ((observed >= OBSERVED) & (children / observed >= RATIO))


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has at most ``BROADCAST`` rows."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def _prefix(segments: Column, depth: Column | int) -> Column:
    return F.array_join(F.slice(segments, 1, depth), SEP)


def _child(parent: Column, segment: Column) -> Column:
    return F.when(parent == "", segment).otherwise(F.concat(parent, F.lit(SEP), segment))


def _nodes(paths: DataFrame) -> DataFrame:
    """(node, parent, segment, observed, below): every prefix with the URLs through it and those that go on below it."""
    parts = paths.where("path <> ''").select(F.split("path", SEP).alias("s"), "n")
    each = parts.select("s", "n", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("depth"))
    each = each.select(_prefix(F.col("s"), F.col("depth")).alias("node"), "n", F.when(F.size("s") > F.col("depth"), F.col("n")).otherwise(0).alias("on"))
    counted = each.groupBy("node").agg(F.sum("n").alias("observed"), F.sum("on").alias("below"))
    last = F.substring_index("node", SEP, -1)
    return counted.select("node", F.left("node", F.greatest(F.length("node") - F.length(last) - 1, F.lit(0))).alias("parent"), last.alias("segment"), "observed", "below")


def _inside(nodes: DataFrame) -> DataFrame:
    """(node, kids, param, through, near) of every prefix that has children: its names, whether it has a parameter, the URLs that go on, and what its children look like.

    Names are told apart by exclusive ors of their hashes, which are counted in
    each task before anything moves.
    """
    name, leaf = F.col("segment") != PARAM, F.col("below") == 0
    counted = nodes.groupBy(F.col("parent").alias("node")).agg(
        F.count_if(name).alias("kids"), F.bool_or(~name).alias("param"), F.bool_or(F.when(~name, leaf)).alias("param_leaf"), F.sum("observed").alias("through"),
        F.bit_xor(F.when(name, F.xxhash64("segment", leaf))).alias("a"), F.bit_xor(F.when(name, F.xxhash64(leaf, "segment"))).alias("b"),
    )
    names = F.concat_ws(" ", F.hex("a"), F.hex("b"), F.col("kids").cast("string"))
    near = F.when(F.col("param"), F.when(F.col("param_leaf"), "*>$").otherwise("*>*")).when(F.col("kids") > NAMED, "*").otherwise(names)
    return counted.select("node", "kids", "param", "through", near.alias("near"))


def _open(inside: DataFrame, settled: DataFrame | None) -> DataFrame:
    """(node, depth, absorbs, kids, through) of the prefixes to decide; absorbs: they have a parameter, which may take names beside it."""
    fresh = ~F.col("param") & _looks_variable(F.col("kids"), F.col("through"))
    depth = F.when(F.col("node") == "", 0).otherwise(F.size(F.split("node", SEP)))
    found = inside.where(fresh | (F.col("param") & (F.col("kids") > 0))).select("node", depth.alias("depth"), F.col("param").alias("absorbs"), "kids", "through")
    return found if settled is None else found.join(settled, "node", "left_anti")


def _ready(open_: DataFrame) -> DataFrame:
    """Those of ``open_`` that can be decided: no other is below one of their names, nor are they below the parameter of one that may still take names."""
    s = F.split("node", SEP)
    step = F.transform(F.sequence(F.lit(0), F.col("depth") - 1), lambda d: F.struct(_prefix(s, d).alias("above"), (F.get(s, d) == PARAM).alias("by_param")))
    above = open_.where("depth > 0").select("node", F.explode(step).alias("x")).select("node", "x.above", "x.by_param")
    waits = above.where("not by_param").select(F.col("above").alias("node"))
    taken = above.where("by_param").join(open_.where("absorbs").select(F.col("node").alias("above")), "above", "left_semi").select("node")
    return open_.join(waits.unionByName(taken).distinct(), "node", "left_anti")


def _decided(nodes: DataFrame, inside: DataFrame, ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((parent, depth, absorbs, fold, several), (parent, segment)): prefixes of which children become the parameter, and the names that stay beside it.

    Counts by (parent, signature) decide, so no task holds all children of a
    parent, and only the names that stay are listed. fold: children have
    parameters themselves, so that everything below them is merged. several:
    children of more than one signature become one.
    """
    own = nodes.join(_small(ready.select(F.col("node").alias("parent"), "depth", "absorbs", F.col("kids").alias("fan"), "through")), "parent")
    shaped = own.join(inside.select("node", F.col("param").alias("deeper"), "near"), "node", "left")
    inner = inside.select(F.col("node").alias("_inner"), F.col("near").alias("inner"))
    # only deeper ones have something to look up; the rest, which is most, keep keys of their own, since one task would hold all that have none
    shaped = shaped.withColumn("_inner", F.when(F.col("deeper"), _child(F.col("node"), F.lit(PARAM))).otherwise(F.col("node"))).join(inner, "_inner", "left")
    # a parameter that ends URLs has nothing inside
    signature = F.when(F.col("near").isNull(), "$").when(F.col("deeper"), F.concat(F.lit("*>"), F.coalesce("inner", F.lit("$")))).otherwise(F.col("near"))
    keys = ("parent", "depth", "absorbs", "fan", "through")
    signed = _checkpoint(shaped.select(*keys, "segment", signature.alias("signature")))
    groups = signed.groupBy(*keys, "signature").agg(F.count_if(F.col("segment") != PARAM).alias("alike"), F.bool_or(F.col("segment") == PARAM).alias("of_param"))
    whole = groups.groupBy("parent").agg(F.count("*").alias("kinds"), F.max(F.when(F.col("of_param"), F.col("signature"))).alias("taking"))
    # what looks like the parameter beside it belongs to it
    chosen = F.when(F.col("absorbs"), F.col("signature") == F.col("taking")).otherwise((F.col("kinds") == 1) | _looks_variable(F.col("alike"), F.col("through")))
    groups = _checkpoint(groups.join(whole, "parent").where("alike > 0").select("parent", "depth", "absorbs", "signature", chosen.alias("chosen")))
    changed = groups.groupBy("parent", "depth", "absorbs").agg(F.bool_or("chosen").alias("some"), F.bool_or(F.col("chosen") & F.col("signature").startswith("*>")).alias("fold"), (F.count_if("chosen") > 1).alias("several")).where("some").drop("some")
    rest = groups.where("not chosen").join(changed, "parent", "left_semi").select("parent", "signature")
    return changed, signed.where(F.col("segment") != PARAM).join(rest, ["parent", "signature"], "left_semi").select("parent", "segment")


def _rewrite(paths: DataFrame, changed: DataFrame, stay: DataFrame, depths: dict[int, int]) -> DataFrame:
    """``paths`` with the chosen segments replaced, merged where they meet. A path is below one changed prefix at most. ``depths``: how many prefixes changed at each."""
    s = F.split("path", SEP)
    size, at = F.when(F.col("path") == "", 0).otherwise(F.size(s)), F.col("at")
    found = paths.select("path", "n", F.lit(None).cast("int").alias("at"), F.lit(False).alias("fold"))
    for depth, n in depths.items():
        own = changed.where(F.col("depth") == depth).select(F.col("parent").alias("_own"), F.col("fold").alias("_fold"))
        met = found.withColumn("_own", F.when(size > depth, _prefix(s, depth))).join(F.broadcast(own) if n <= BROADCAST else own, "_own", "left")
        found = met.select("path", "n", F.coalesce("at", F.when(F.col("_fold").isNotNull(), F.lit(depth))).alias("at"), (F.col("fold") | F.coalesce("_fold", F.lit(False))).alias("fold"))
    keyed = found.withColumns({"parent": F.when(at.isNotNull(), _prefix(s, at)), "segment": F.when(at.isNotNull(), F.get(s, at))})
    met = keyed.join(_small(_checkpoint(stay).withColumn("stays", F.lit(True))), ["parent", "segment"], "left")
    hit = at.isNotNull() & F.col("stays").isNull() & (F.col("segment") != PARAM)
    values = F.when(F.col("fold") & (size > at + 1), 2).otherwise(1)
    new = F.concat(F.slice(s, 1, at), F.array_repeat(F.lit(PARAM), values), F.slice(s, at + values + 1, F.greatest(size - at - values, F.lit(0))))
    return met.select(F.when(hit, F.array_join(new, SEP)).otherwise(F.col("path")).alias("path"), "n").groupBy("path").agg(F.sum("n").alias("n"))


def _settle(settled: DataFrame | None, ready: DataFrame, changed: DataFrame) -> DataFrame:
    """(node) of the prefixes that are decided for now: those that kept their children or took names once, unless they are below a parameter that got more.

    Where children of one signature became the parameter, it still has theirs,
    and no other name has; only else names may look like it.
    """
    done = ready.join(changed.where("not absorbs and (several or fold)").select(F.col("parent").alias("node")), "node", "left_anti").select("node")
    if settled is None:
        return _checkpoint(done)
    grown = changed.select(_child(F.col("parent"), F.lit(PARAM)).alias("above"))
    s = F.split("node", SEP)
    again = settled.where("node <> ''").select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size(s)), lambda d: _prefix(s, d))).alias("above")).join(grown, "above", "left_semi").select("node")
    return _checkpoint(settled.join(again, "node", "left_anti").unionByName(done))


def learn_from_counts(paths: DataFrame) -> DataFrame:
    """Rules (parent, literal) of counted paths (path, n).

    A row with a null literal says that the segment after the prefix ``parent``
    is a value; the other rows name the literals that aren't. Prefixes are
    rewritten ones. Each round reads the counted paths twice and takes them once
    more to be rewritten, whatever the number of levels. A name that merged
    branches hold both as a value and as a literal is a literal. A task reads at
    most ``TASK_BYTES`` of a shuffle that has enough partitions.
    """
    with small_partitions(paths.sparkSession):
        paths, settled = _checkpoint(paths), None
        nodes = inside = None
        while True:
            if nodes is None:
                nodes = _checkpoint(_nodes(paths))
                inside = _checkpoint(_inside(nodes))
            open_ = _checkpoint(_open(inside, settled))
            if open_.isEmpty():
                break
            ready = open_ if open_.limit(2).count() == 1 else _checkpoint(_ready(open_))
            changed, stay = _decided(nodes, inside, ready)
            depths = {r.depth: r["count"] for r in changed.groupBy("depth").count().orderBy("depth").collect()}
            settled = _settle(settled, ready, changed)
            if depths:
                before = (paths, nodes, inside)
                paths, nodes = _checkpoint(_rewrite(paths, changed, stay, depths)), None
                forget(*before)
        slots = inside.where("param").select(F.col("node").alias("parent"))
        beside = nodes.where(F.col("segment") != PARAM).join(slots, "parent", "left_semi").select("parent", F.col("segment").alias("literal"))
        return _checkpoint(slots.select("parent", F.lit(None).cast("string").alias("literal")).unionByName(beside))


def learn_patterns(urls: DataFrame, segments: str = "segments") -> DataFrame:
    """Rules of the URLs' segments, see ``learn_from_counts``; ``assign_patterns`` applies them.

    Null segments are left out; an empty table has no rules.
    """
    return learn_from_counts(path_counts(urls.where(F.col(segments).isNotNull()), segments))


def assign_patterns(urls: DataFrame, rules: DataFrame, segments: str = "segments") -> DataFrame:
    """``urls`` with ``template``; null segments have none.

    Up to ``INLINE`` rules are part of one projection, which walks each URL's
    segments; nothing moves. More of them are joined to the distinct paths, once
    for each depth that has rules.
    """
    known = rules.limit(INLINE + 1).collect()
    if len(known) <= INLINE:
        return urls.withColumn("template", walk(F.col(segments), [r.parent for r in known if r.literal is None], [(r.parent, r.literal) for r in known if r.literal is not None]))
    depth = F.when(F.col("parent") == "", 0).otherwise(F.size(F.split("parent", SEP)))
    depths = sorted(r.depth for r in rules.select(depth.alias("depth")).distinct().collect())
    now = path_counts(urls.where(F.col(segments).isNotNull()), segments).select("path", F.col("path").alias("now"))
    slots = _small(rules.where("literal is null").select("parent", F.lit(True).alias("slot")))
    names = _small(rules.where("literal is not null").select("parent", F.col("literal").alias("segment"), F.lit(True).alias("name")))
    s = F.split("now", SEP)
    for d in depths:
        size = F.when(F.col("now") == "", 0).otherwise(F.size(s))
        keyed = now.withColumns({"parent": F.when(size > d, _prefix(s, d)), "segment": F.when(size > d, F.get(s, F.lit(d)))})
        met = keyed.join(slots, "parent", "left").join(names, ["parent", "segment"], "left")
        new = F.array_join(F.concat(F.slice(s, 1, d), F.array(F.lit(PARAM)), F.slice(s, d + 2, F.greatest(size - d - 1, F.lit(0)))), SEP)
        now = met.select("path", F.when(F.col("slot") & F.col("name").isNull(), new).otherwise(F.col("now")).alias("now"))
    named = now.select(F.col("path").alias("_path"), _template(F.col("now")).alias("template"))
    return urls.withColumn("_path", F.array_join(segments, SEP)).join(named, "_path", "left").drop("_path")


def _template(prefix: Column) -> Column:
    return F.concat(F.lit("/"), F.replace(prefix, F.lit(SEP), F.lit("/")))


def walk(segments: Column, slots: list[str], names: list[tuple[str, str]]) -> Column:
    """The template of segments by rules: the prefixes with a value after them, and the (prefix, literal) that aren't values. Both are looked up in hash sets."""
    if not slots:
        return _template(F.array_join(segments, SEP))
    held = [name if parent == "" else f"{parent}{SEP}{name}" for parent, name in names]

    def step(now: Column, segment: Column) -> Column:
        own = _child(now, segment)
        value = now.isin(slots) & ~own.isin(held) if held else now.isin(slots)
        return F.when(value, _child(now, F.lit(PARAM))).otherwise(own)

    return _template(F.aggregate(segments, F.lit(""), step))


def pattern_summary(assigned: DataFrame) -> DataFrame:
    """Patterns with their exact populations, largest first."""
    arity = F.when(F.col("template") == "/", 0).otherwise(F.size(F.split("template", "/")) - 1)
    return assigned.groupBy("template").agg(F.count("*").alias("population_count"), F.count_distinct("file_id").alias("file_count")).withColumn("segment_count", arity).orderBy(F.desc("population_count"), "template")


def pattern_population(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("template", "file_id").agg(F.count("*").alias("url_count"))


def merge_pattern_passes(*passes: DataFrame) -> DataFrame:
    """The counted paths (path, n) of several passes together; ``learn_from_counts`` decides on their combined evidence."""
    return reduce(DataFrame.unionByName, (p.select("path", "n") for p in passes)).groupBy("path").agg(F.sum("n").alias("n"))


def parameterisation_report(assigned: DataFrame) -> DataFrame:
    observed = F.count("*")
    return assigned.agg(
        observed.alias("observed_urls"), (observed < OBSERVED).alias("below_floor"), F.greatest(F.lit(0), F.lit(OBSERVED) - observed).alias("shortfall"),
        F.count_distinct("template").alias("templates"), F.count_distinct(F.when(F.col("template").contains(PARAM), F.col("template"))).alias("parameterised"),
        F.lit(MANY).alias("unique_threshold"), F.lit(RATIO).alias("ratio_threshold"),
    )


def group_by_shape(paths: DataFrame, path: str = "path") -> DataFrame:
    return paths.groupBy(path_shape(F.col(path)).alias("shape")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "shape")


def stratify_by_shape(assigned: DataFrame, path: str = "path") -> DataFrame:
    return assigned.groupBy("template", path_shape(F.col(path)).alias("shape")).agg(F.count("*").alias("population"))


def split_locs(locs: DataFrame, base_url: str, host: str) -> DataFrame:
    """``locs`` with the parsed columns of each location."""
    from pathsieve.functions.urls import parse_loc

    return locs.withColumn("_p", parse_loc(F.col("loc"), F.lit(base_url), F.lit(host))).select("*", "_p.*").drop("_p")


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("file_id", "kind").agg(F.count("*").alias("n"))


def foreign_hosts(split: DataFrame) -> DataFrame:
    return split.where("kind = 'foreign'").groupBy("detected_host").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "detected_host")


def split_samples(split: DataFrame, n: int = 10) -> DataFrame:
    """First n foreign and unparseable locations (n is the report's size)."""
    rows = split.where("kind <> 'matched'")
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("kind").orderBy("file_id", "ordinal"))).where(F.col("_r") <= n).drop("_r")


def derive_host(lines: DataFrame, url: str = "url") -> DataFrame:
    """The dominant host of the lines, ``paths.invalid`` if none has one."""
    from pathsieve.functions.urls import normalize_host

    host = normalize_host(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    counts = lines.select(host.alias("host")).where("host <> ''").groupBy("host").agg(F.count("*").alias("n"))
    top = counts.agg(F.min_by("host", F.struct((-F.col("n")).alias("n"), "host")).alias("host"))
    return top.select(F.coalesce("host", F.lit("paths.invalid")).alias("host"))


def resolve_candidates(samples: DataFrame, locs: DataFrame, base_url: Column | str, host: Column | str) -> DataFrame:
    """Each sampled (file_id, ordinal, hash) with its URL again (path, loc), and a typed status.

    One join for all patterns; ``locs`` (file_id, ordinal, loc) are read as they
    are, and only those that are sampled are parsed. A file with any failure has
    ``file_ok`` false.
    """
    # the sample is small beside the locations, so it is kept and they are read once
    rows = _checkpoint(_located(samples, locs, base_url, host))
    return rows.join(rows.groupBy("file_id").agg(F.bool_and(F.col("status") == "resolved").alias("file_ok")), "file_id")


def _located(samples: DataFrame, locs: DataFrame, base_url: Column | str, host: Column | str) -> DataFrame:
    """``samples`` with loc, path and status."""
    from pathsieve.functions.urls import parse_loc, stable_hash

    base_url, host = (F.lit(x) if isinstance(x, str) else x for x in (base_url, host))
    wanted = samples.select("file_id", "ordinal").distinct()
    n = wanted.limit(BROADCAST + 1).count()
    hits = locs.join(F.broadcast(wanted) if n <= BROADCAST else wanted, ["file_id", "ordinal"], "left_semi")
    found = hits.withColumn("_p", parse_loc(F.col("loc"), base_url, host)).select("file_id", "ordinal", "loc", F.col("_p.kind").alias("kind"), F.col("_p.path").alias("path"), F.lit(True).alias("here"))
    # a file is known if it has any location; only sampled files are looked for
    files = locs.select("file_id").join(F.broadcast(wanted.select("file_id")) if n <= BROADCAST else wanted.select("file_id"), "file_id", "left_semi").distinct().withColumn("known", F.lit(True))
    rows = samples.join(found, ["file_id", "ordinal"], "left").join(files, "file_id", "left")
    status = (
        F.when(F.col("known").isNull(), "unknown_file").when(F.col("here").isNull(), "missing_ordinal").when(F.col("kind") != "matched", "off_host")
        .when(stable_hash(F.col("path")) != F.col("hash"), "hash_mismatch").otherwise("resolved")
    )
    return rows.withColumn("status", status).drop("here", "known", "kind")
