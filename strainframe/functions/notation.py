"""Mutation notation as column expressions: tables of notations are parsed, resolved and joined as a whole."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import cut, dimension
from .scalars import AA_CODES, NT_CODES, lookup

#: Notations that a task parses.
PARSED_ROWS = 20_000

NAMES = r"^(\^*)(?:([A-Za-z0-9_.-]+):)?(?:([A-Za-z0-9_.-]+):)?"
CHANGE = NAMES + r"([A-Z*]+)([0-9]+)(=?[A-Zxn*]+)$"
DELETION = NAMES + r"del:(=?[0-9]+)(?:-(=?[0-9]+))?$"


def parsed(notation: Column) -> Column:
    """negated, two names, form (del, change or null), ref, first, last, alt of a notation."""
    part = lambda pattern, i: F.nullif(F.regexp_extract(notation, pattern, i), F.lit(""))
    gone, changed = notation.rlike(DELETION), notation.rlike(CHANGE)
    pick = lambda i: F.when(gone, part(DELETION, i)).otherwise(part(CHANGE, i))
    number = lambda c: F.replace(c, F.lit("="), F.lit("")).cast("int")
    return F.struct(
        (F.length(F.coalesce(pick(1), F.lit(""))) % 2 == 1).alias("negated"), pick(2).alias("name1"), pick(3).alias("name2"), F.when(gone, "del").when(changed, "change").alias("form"),
        F.when(~gone, part(CHANGE, 4)).alias("ref"), F.when(gone, number(part(DELETION, 4))).otherwise(part(CHANGE, 5).cast("int")).alias("first"),
        F.when(gone, number(F.coalesce(part(DELETION, 5), part(DELETION, 4)))).otherwise(part(CHANGE, 5).cast("int")).alias("last"), F.when(~gone, F.replace(part(CHANGE, 6), F.lit("="), F.lit(""))).alias("alt"))


def resolved(notations: DataFrame, genes: DataFrame, replicons: DataFrame, column: str = "notation") -> DataFrame:
    """notations with negated, kind (nt or aa), what (snp, ins or del), replicon, gene, ref, first, last, alts and error.

    A name is a replicon or a gene; with two, the first is the replicon. genes: gene; replicons: replicon, reference.
    A notation without a replicon takes the only one there is; where there are several it is an error to leave it out of an nt notation.
    Both tables are small dimensions.
    """
    # A file of a million notations is one task, and parsing is the work here.
    notations = notations.repartition(notations.count() // PARSED_ROWS + 1)
    p = notations.withColumn("_p", parsed(F.col(column))).select("*", "_p.*").drop("_p")
    gene_names = genes.select(F.col("gene").alias("_gene")).distinct()
    names = replicons.select(F.col("replicon").alias("_replicon")).distinct()
    only = names.agg(F.when(F.count("*") == 1, F.first("_replicon")).alias("_only"))
    as_gene = p.join(gene_names, F.coalesce("name2", "name1") == F.col("_gene"), "left")
    both = as_gene.join(names, F.col("name1") == F.col("_replicon"), "left").crossJoin(F.broadcast(only))
    is_gene = F.col("_gene").isNotNull()
    replicon = F.coalesce("_replicon", "_only")
    error = (
        F.when(F.col("form").isNull(), "not a notation").when(F.col("name2").isNotNull() & (F.col("_replicon").isNull() | ~is_gene), "unknown name")
        .when(F.col("name2").isNull() & F.col("name1").isNotNull() & F.col("_replicon").isNull() & ~is_gene, "unknown name").when(~is_gene & replicon.isNull(), "replicon needed")
    )
    kind = F.when(is_gene, "aa").otherwise("nt")
    codes = F.when(kind == "nt", lookup(NT_CODES, F.col("alt"))).otherwise(lookup(AA_CODES, F.col("alt")))
    error = error.when((F.col("form") == "change") & (F.length("alt") == 1) & codes.isNull() & (F.col("alt") != "*"), "unknown code")
    what = F.when(F.col("form") == "del", "del").when(F.length("alt") > 1, "ins").when(F.col("form") == "change", "snp")
    alts = F.when(what == "snp", F.coalesce(F.split(codes, ""), F.array("alt"))).when(what == "ins", F.array("alt")).otherwise(F.array(F.lit("")))
    return both.select(*notations.columns, "negated", kind.alias("kind"), what.alias("what"), replicon.alias("replicon"), F.col("_gene").alias("gene"), "ref", "first", "last", alts.alias("alts"), error.alias("error"))


PLACE = ["kind", "replicon", "gene", "start", "end", "ref", "k_alt"]


def _wanted(profiles: DataFrame) -> DataFrame:
    """The notations without errors, each with member: a hash of what it says. A table, as several passes read it and each would parse again."""
    return cut(profiles.where(F.col("error").isNull()).withColumn("member", F.xxhash64("kind", "replicon", "gene", "ref", "first", "last", F.array_join("alts", ","))))


def _keys(wanted: DataFrame) -> DataFrame:
    """An equality key for each alt that a notation accepts."""
    return wanted.select("profile", "member", "negated", "kind", "what", "replicon", "gene", F.when(F.col("what") != "del", F.col("ref")).alias("k_ref"), F.when(F.col("what") == "del", F.col("first") - 1).otherwise(F.col("last") - 1).alias("k_start"), F.col("last").alias("k_end"), F.explode("alts").alias("k_alt"))


def _keyed(facts: DataFrame, k: DataFrame) -> DataFrame:
    """Facts (with k_alt) aliased f, joined to keys aliased k. A key without a gene, replicon or ref takes any."""
    on = (F.col("f.kind") == F.col("k.kind")) & (F.col("f.start") == F.col("k_start")) & (F.col("f.end") == F.col("k_end")) & (F.col("f.k_alt") == F.col("k.k_alt"))
    on = on & (F.col("k.gene").isNull() | (F.col("f.gene") == F.col("k.gene"))) & (F.col("k.replicon").isNull() | (F.col("f.replicon") == F.col("k.replicon"))) & (F.col("k_ref").isNull() | (F.col("f.ref") == F.col("k_ref")))
    return facts.alias("f").join(k.alias("k"), on)


def _with_alt(facts: DataFrame) -> DataFrame:
    return facts.withColumn("k_alt", F.trim(F.coalesce("alt", F.lit(""))))


def _needs(wanted: DataFrame) -> DataFrame:
    return wanted.where(~F.col("negated")).select("profile", "member").distinct().groupBy("profile").agg(F.count("*").alias("need"))


def _complete(hits: DataFrame, need: DataFrame, entity: str) -> DataFrame:
    """profile and entity whose distinct hits (profile, entity, member, negated) are all that a profile needs, and none that it bars."""
    return hits.groupBy("profile", entity).agg(F.count(F.when(~F.col("negated"), 1)).alias("have"), F.max("negated").alias("barred")).join(need, "profile").where((F.col("have") == F.col("need")) & ~F.col("barred")).select("profile", entity)


def matched(profiles: DataFrame, facts: DataFrame, entity: str = "sample") -> DataFrame:
    """profile and entity for every entity that carries all notations of a profile, negated ones excepted.

    profiles: profile and the columns of resolved(); facts: entity, kind, replicon, gene, start, end, ref, alt. Notations become
    equality keys, one for each accepted alt, so the facts are joined by hash and not by ranges.
    """
    wanted = _wanted(profiles)
    # A watch-list is small beside the facts, one mutation of which nearly all samples may carry: broadcast, facts stay where they are.
    hits = _keyed(_with_alt(facts), dimension(_keys(wanted))).select(F.col(f"f.{entity}").alias(entity), "profile", "member", "negated").distinct()
    return _complete(hits, _needs(wanted), entity)


def _mutation(alias: str = "") -> Column:
    """A mutation's hash. Nulls are told apart by where they stand, numbers are of one type."""
    columns = [(F.col(f"{alias}{c}").cast("long") if c in ("start", "end") else F.col(f"{alias}{c}")) for c in PLACE]
    return F.xxhash64(*(x for c in columns for x in (c.isNull(), c)))


def frequencies(facts: DataFrame) -> DataFrame:
    """The distinct mutations of facts, each with n, how many rows have it: pre-aggregated before its shuffle, and worth keeping beside the facts."""
    return _with_alt(facts).groupBy(*PLACE).agg(F.count("*").alias("n"))


@dataclass
class Waiting:
    """Profiles at their rarest mutations. A mutation is its hash m; a profile that nobody can meet waits nowhere."""

    members: DataFrame  # profile, member, negated, m: all mutations that a profile takes or bars
    rarest: DataFrame  # profile, m: the mutations of the one member at which it waits
    need: DataFrame  # profile, need


def waiting(profiles: DataFrame, counted: DataFrame) -> Waiting:
    """Profiles put where the fewest facts are. counted: frequencies() of the facts. Ties go by the member's hash."""
    wanted = _wanted(profiles)
    need = _needs(wanted)
    hits = _keyed(counted, dimension(_keys(wanted))).select("profile", "member", "negated", _mutation("f.").alias("m"), "f.n").distinct()
    met = cut(hits)
    # How often a member is carried at most. A profile with a needed member that nobody carries has fewer members here than it needs.
    carried = met.where(~F.col("negated")).groupBy("profile", "member").agg(F.sum("n").alias("n"))
    best = carried.groupBy("profile").agg(F.min(F.struct("n", "member")).alias("least"), F.count("*").alias("have")).join(need, "profile").where("have = need").select("profile", "need", F.col("least.member").alias("member"))
    rarest = met.where(~F.col("negated")).join(best, ["profile", "member"]).select("profile", "m")
    members = met.join(best.select("profile"), "profile", "left_semi").select("profile", "member", "negated", "m")
    return Waiting(cut(members), cut(rarest), best.select("profile", "need"))


def candidates(w: Waiting, carried: DataFrame, entity: str = "sample") -> DataFrame:
    """profile and entity that meet at the profile's rarest mutation. carried: entity and m, distinct."""
    return carried.join(dimension(w.rarest), "m").select("profile", entity).distinct()


def matched_by_rarest(profiles: DataFrame, facts: DataFrame, entity: str = "sample", counted: DataFrame | None = None) -> DataFrame:
    """matched(), by set containment with one-element prefixes: an entity meets a profile at the profile's rarest mutation only, and then shows the others.

    So a mutation that all samples carry is never the key at which profiles and samples meet, unless a profile has nothing rarer; rows are those of
    candidates times the members of their profiles. counted: frequencies() of the facts where they are kept, else they are counted in a pass more;
    they may be higher than the facts have, which costs time only, but no mutation may lack.
    """
    w = waiting(profiles, frequencies(facts) if counted is None else counted)
    watched = dimension(w.members.select("m").distinct())
    carried = cut(_with_alt(facts).select(entity, _mutation().alias("m")).join(watched, "m", "left_semi").distinct())
    asked = candidates(w, carried, entity).join(dimension(w.members), "profile")
    hits = asked.join(carried, [entity, "m"], "left_semi").select("profile", entity, "member", "negated").distinct()
    return _complete(hits, w.need, entity)
