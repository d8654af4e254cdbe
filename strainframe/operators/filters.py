"""Filter trees over samples.

A tree is a dict: an own leaf (label and values), andFilter, orFilter. It compiles to flags and one boolean column: all
leaves on one fact table become flags of a single aggregation by sample, so a tree of many leaves scans each fact once.
exclude is the exact complement of its leaf: nulls stay (see README, decisions).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.notation import CHANGE, DELETION
from ..functions.scalars import AA_CODES, NT_CODES, deleted

LOOKUPS: dict[str, Callable[[Column, object], Column]] = {
    "exact": lambda c, v: c == v if v is not None else c.isNull(),
    "iexact": lambda c, v: F.lower(c) == str(v).lower(),
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "icontains": lambda c, v: F.contains(F.lower(c), F.lit(str(v).lower())),
    "in": lambda c, v: c.isin(*v),
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "startswith": lambda c, v: F.startswith(c, F.lit(v)),
    "istartswith": lambda c, v: F.startswith(F.lower(c), F.lit(str(v).lower())),
    "endswith": lambda c, v: F.endswith(c, F.lit(v)),
    "iendswith": lambda c, v: F.endswith(F.lower(c), F.lit(str(v).lower())),
    "range": lambda c, v: c.between(v[0], v[1]),
    "isnull": lambda c, v: c.isNull() if v else c.isNotNull(),
    "regex": lambda c, v: c.rlike(v),
    "iregex": lambda c, v: c.rlike(f"(?i){v}"),
}
PARTS = {"year": F.year, "month": F.month, "day": F.dayofmonth}


def predicate(column: Column, lookup: str, value: object) -> Column:
    """A lookup on a column; `year__gte` and the like look at a part of a date."""
    part, _, rest = lookup.partition("__")
    if part in PARTS:
        column, lookup = PARTS[part](column), rest or "exact"
    if lookup not in LOOKUPS:
        raise ValueError(f"unknown lookup {lookup!r}")
    return LOOKUPS[lookup](column, value)


def coerced(value: object, lookup: str) -> object:
    """Lists and ranges from comma lists; contains without its wildcards."""
    if isinstance(value, str):
        if lookup in ("in", "range"):
            return [x.strip() for x in value.strip("[]()").split(",")]
        if lookup in ("contains", "icontains"):
            return value.strip("%")
    return value


@dataclass
class Tables:
    """What trees are compiled against. Facts have the entity's column and one row for each thing that the entity carries."""

    samples: DataFrame
    entity: str = "sample"
    nt: DataFrame | None = None  # entity, replicon, start, end, ref, alt
    aa: DataFrame | None = None  # entity, replicon, gene, start, end, ref, alt
    eav: DataFrame | None = None  # entity, name, value columns
    annotations: DataFrame | None = None  # entity, mutation, ontology, impact
    sequences: DataFrame | None = None  # entity, length
    placed: DataFrame | None = None  # entity, replicon, reference
    lineages: DataFrame | None = None  # lineage, parent, reference
    labels: DataFrame | None = None  # reference, lineage, first, last (lineage_index); lineage_at of samples is of the trees' reference
    eav_columns: dict[str, str] = field(default_factory=dict)  # property: value column
    genes: frozenset[str] = frozenset()  # names that notations may use
    replicons: frozenset[str] = frozenset()


@dataclass
class Leaf:
    """A condition on samples (column), or on the rows of a fact (fact, rows): true where any row meets it."""

    column: Column | None = None
    fact: str | None = None
    rows: Column | None = None
    members: DataFrame | None = None  # or the entities that meet it
    exclude: bool = False


def _codes(alt: str, codes: dict[str, str]) -> list[str]:
    if len(alt) == 1 and alt not in codes and alt != "*":
        raise ValueError(f"unknown code {alt!r}")
    return list(codes[alt]) if alt in codes else [alt]


def _property(t: Tables, f: dict) -> Leaf:
    name, lookup = f["property_name"], f.get("filter_type", "exact")
    value = coerced(f.get("value"), lookup)
    if name == "length" and t.sequences is not None:
        return Leaf(fact="sequences", rows=predicate(F.col("length"), lookup, value))
    if name in t.samples.columns:
        return Leaf(column=predicate(F.col(name), lookup, value))
    if name not in t.eav_columns:
        raise ValueError(f"unknown property {name!r}")
    return Leaf(fact="eav", rows=(F.col("name") == name) & predicate(F.col(t.eav_columns[name]), lookup, value))


def _place(f: dict) -> Column:
    return F.col("replicon") == f["replicon_accession"] if f.get("replicon_accession") else F.lit(True)


def _snp(f: dict, codes: dict[str, str]) -> Column:
    end = int(f["ref_pos"])
    return (F.col("end") == end) & (F.col("start") == end - 1) & F.col("alt").isin(*_codes(f.get("alt_nuc") or f.get("alt_aa"), codes)) & (F.col("ref") == (f.get("ref_nuc") or f.get("ref_aa")))


def _gone(f: dict) -> Column:
    first = int(f["first_deleted"])
    return (F.col("start") == first - 1) & (F.col("end") == int(f.get("last_deleted") or first)) & deleted("alt")


def _gene(f: dict) -> Column:
    return F.col("gene") == f["protein_symbol"]


def _inserted(f: dict) -> Column:
    return (F.col("end") == int(f["ref_pos"])) & (F.col("ref") == (f.get("ref_nuc") or f.get("ref_aa"))) & (F.col("alt") == (f.get("alt_nuc") or f.get("alt_aa")))


def _numbered(t: Tables, spans: list[tuple[int, int]], names: list[str], reference: str) -> Leaf:
    """Lineages by ranges of their numbers: a condition on lineage_at where samples carry it, else on the labels."""
    if not spans:
        raise ValueError(f"no lineage found among {names}")
    within = lambda c: reduce(or_, (F.col(c).between(*s) for s in spans))
    if "lineage_at" in t.samples.columns:
        return Leaf(column=within("lineage_at"))
    found = t.labels.where((F.col("reference") == reference) & within("first"))
    return Leaf(members=t.samples.join(found.select("lineage"), "lineage", "left_semi").select(t.entity))


def _sublineages(t: Tables, f: dict, reference: str | None) -> Leaf:
    from .lineage import descendants
    from .lineage_index import ranges

    names = [x.lower() for x in (f["lineageList"] if isinstance(f["lineageList"], list) else [f["lineageList"]])]
    if t.labels is not None and reference is not None and f.get("includeSublineages", True):
        spans = ranges(t.labels, names, reference)
        if spans is not None:
            return _numbered(t, spans, names, reference)
    edges = t.lineages if reference is None else t.lineages.where(F.col("reference") == reference)
    roots = edges.where(F.lower("lineage").isin(*names)).select("lineage").distinct()
    if roots.isEmpty():
        raise ValueError(f"no lineage found among {names}")
    found = descendants(edges, roots) if f.get("includeSublineages", True) else roots
    return Leaf(members=t.samples.join(found.select("lineage").distinct(), "lineage", "left_semi").select(t.entity))


def _annotation(t: Tables, f: dict) -> Leaf:
    conditions = [predicate(F.col(c), f.get("filter_type", "exact"), coerced(f[k], f.get("filter_type", "exact"))) for c, k in (("ontology", "ontology"), ("impact", "impact")) if f.get(k)]
    if f.get("property_name"):
        conditions.append(predicate(F.col({"seq_ontology": "ontology"}.get(f["property_name"], f["property_name"])), f.get("filter_type", "exact"), coerced(f.get("value"), f.get("filter_type", "exact"))))
    if f.get("same_mutation") or len(conditions) == 1:
        rows = conditions[0]
        for c in conditions[1:]:
            rows = rows & c
        return Leaf(fact="annotations", rows=rows)
    members = [t.annotations.where(c).select(t.entity).distinct() for c in conditions]
    both = members[0]
    for m in members[1:]:
        both = both.join(m, t.entity, "left_semi")
    return Leaf(members=both)


def leaf(t: Tables, f: dict, reference: str | None = None) -> Leaf:
    """The condition of one filter."""
    kind = f["label"]
    made = {
        "Property": lambda: _property(t, f),
        "Sample": lambda: Leaf(column=F.col(t.entity).isin(*f["value"]) if len(f["value"]) <= 1000 else None, members=None if len(f["value"]) <= 1000 else t.samples.sparkSession.createDataFrame([(x,) for x in f["value"]], t.samples.select(t.entity).schema)),
        "Replicon": lambda: Leaf(fact="placed", rows=F.col("replicon") == f["accession"]),
        "Reference": lambda: Leaf(fact="placed", rows=F.col("reference") == f["accession"]),
        "Lineages": lambda: _sublineages(t, f, reference),
        "Sublineages": lambda: _sublineages(t, f, reference),
        "Annotation": lambda: _annotation(t, f),
        "SNP Nt": lambda: Leaf(fact="nt", rows=_place(f) & _snp(f, NT_CODES)),
        "SNP AA": lambda: Leaf(fact="aa", rows=_place(f) & _gene(f) & _snp(f, AA_CODES)),
        "Del Nt": lambda: Leaf(fact="nt", rows=_place(f) & _gone(f)),
        "Del AA": lambda: Leaf(fact="aa", rows=_place(f) & _gene(f) & _gone(f)),
        "Ins Nt": lambda: Leaf(fact="nt", rows=_place(f) & _inserted(f)),
        "Ins AA": lambda: Leaf(fact="aa", rows=_place(f) & _gene(f) & _inserted(f)),
    }
    if kind not in made:
        raise ValueError(f"unknown filter {kind!r}")
    out = made[kind]()
    out.exclude = bool(f.get("exclude"))
    return out


def _leaves(tree: dict) -> list[dict]:
    own = [tree] if "label" in tree else []
    return own + [x for k in ("andFilter", "orFilter") for sub in tree.get(k) or [] for x in _leaves(sub)]


def expanded(t: Tables, tree: dict) -> dict:
    """The tree with each "DNA/AA Profile" leaf (value: notations between commas, semicolons or blanks) as the tree of its notations."""
    node = {k: v for k, v in tree.items() if k not in ("andFilter", "orFilter")}
    subs = {k: [expanded(t, x) for x in tree.get(k) or []] for k in ("andFilter", "orFilter") if tree.get(k)}
    if node.get("label") != "DNA/AA Profile":
        return node | subs
    notations = [x for x in re.split(r"[,;\s]+", node["value"]) if x]
    if not notations:
        raise ValueError("a profile of no notation")
    profile = profile_tree([notations], t.genes, t.replicons, bool(node.get("exclude")))
    return {"andFilter": [profile, *subs.get("andFilter", [])]} | ({"orFilter": subs["orFilter"]} if "orFilter" in subs else {})


def _met(hit: Column, exclude: bool) -> Column:
    """A leaf's condition. Null counts as false, as a tree negates its leaves alone; only a negated leaf must say so, and the others reach the scan as they are."""
    return ~F.coalesce(hit, F.lit(False)) if exclude else hit


def compiled(t: Tables, tree: dict, reference: str | None = None) -> tuple[DataFrame, Column]:
    """The samples with a flag for each fact leaf, and the tree over columns and flags."""
    leaves = _leaves(tree)
    made = {id(f): leaf(t, f, reference) for f in leaves}
    out, conditions, by_fact = t.samples, {}, {}
    for i, f in enumerate(leaves):
        x = made[id(f)]
        hit = F.col(f"_leaf{i}") if x.column is None else x.column
        if x.column is None:
            if x.fact:
                by_fact.setdefault(x.fact, []).append((i, x.rows))
            else:
                out = out.join(x.members.select(t.entity).distinct().withColumn(f"_leaf{i}", F.lit(True)), t.entity, "left")
        conditions[id(f)] = _met(hit, x.exclude)
    for fact, rows in by_fact.items():
        hits = [F.coalesce(r, F.lit(False)) for _, r in rows]
        some = hits[0]
        for h in hits[1:]:
            some = some | h
        flags = getattr(t, fact).where(some).groupBy(t.entity).agg(*(F.bool_or(h).alias(f"_leaf{i}") for (i, _), h in zip(rows, hits, strict=True)))
        out = out.join(flags, t.entity, "left")

    def whole(node: dict) -> Column | None:
        parts = ([conditions[id(node)]] if "label" in node else []) + [c for sub in node.get("andFilter") or [] if (c := whole(sub)) is not None]
        result = None
        for c in parts:
            result = c if result is None else result & c
        for sub in node.get("orFilter") or []:
            if (c := whole(sub)) is not None:
                result = c if result is None else result | c
        return result

    condition = whole(tree)
    return out, F.lit(True) if condition is None else condition


def matching(t: Tables, tree: dict, reference: str | None = None) -> DataFrame:
    """The samples that a tree keeps, with the columns of samples. One plain fact leaf is a semi or anti join."""
    samples = t.samples
    if reference is not None and t.placed is not None:
        samples = samples.join(t.placed.where(F.col("reference") == reference).select(t.entity), t.entity, "left_semi")
    scoped = Tables(**{**t.__dict__, "samples": samples})
    tree = expanded(scoped, tree)
    leaves = _leaves(tree)
    if len(leaves) == 1:
        only = leaf(scoped, leaves[0], reference)
        if only.column is not None:
            return samples.where(_met(only.column, only.exclude))
        hits = only.members if only.fact is None else getattr(t, only.fact).where(only.rows)
        return samples.join(hits.select(t.entity), t.entity, "left_anti" if only.exclude else "left_semi")
    flagged, condition = compiled(scoped, tree, reference)
    return flagged.where(condition).select(*samples.columns)


def profile_filters(notations: list[str], genes: set[str] = frozenset(), replicons: set[str] = frozenset()) -> list[dict]:
    """Filters of notations as text, for trees, read by the patterns of functions.notation, which reads tables of them."""
    out = []
    for text in notations:
        gone = re.match(DELETION, text)
        m = gone or re.match(CHANGE, text)
        if not m:
            raise ValueError(f"not a notation: {text!r}")
        names = [n for n in (m[2], m[3]) if n]
        gene = next((n for n in reversed(names) if n in genes), None)
        replicon = next((n for n in names if n in replicons), None)
        if len([n for n in (gene, replicon) if n]) != len(names):
            raise ValueError(f"unknown name in {text!r}")
        own = {"exclude": len(m[1]) % 2 == 1, "replicon_accession": replicon, "protein_symbol": gene}
        side, plain = "AA" if gene else "Nt", lambda x: x and x.replace("=", "")
        if gone:
            out.append(own | {"label": f"Del {side}", "first_deleted": plain(m[4]), "last_deleted": plain(m[5])})
        else:
            alt = plain(m[6])
            out.append(own | {"label": f"{'Ins' if len(alt) > 1 else 'SNP'} {side}", "ref_nuc": m[4], "ref_pos": m[5], "alt_nuc": alt})
    return out


def profile_tree(profiles: list[list[str]], genes: set[str] = frozenset(), replicons: set[str] = frozenset(), exclude: bool = False) -> dict:
    """All notations within a profile, any of the profiles; exclude negates each profile as a whole (De Morgan)."""
    if exclude:
        return {"andFilter": [{"orFilter": [f | {"exclude": not f["exclude"]} for f in profile_filters(p, genes, replicons)]} for p in profiles]}
    return {"orFilter": [{"andFilter": profile_filters(p, genes, replicons)} for p in profiles]}


def property_tree(name: str, values: list[str], datatype: str) -> dict:
    """The value mini-language: ^ negates; =, !=, >, >=, <, <= compare; a:b is a range; % at an end is a wildcard. Values are alternatives."""
    read = {"integer": int, "float": float, "date": date.fromisoformat}.get(datatype, str)
    out = []
    for text in values:
        negated, rest = text.startswith("^"), text.lstrip("^")
        f = {"label": "Property", "property_name": name, "exclude": negated}
        if m := re.fullmatch(r"(!=|>=|<=|=|>|<)\s*(.+)", rest):
            op = {"=": "exact", "!=": "exact", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}[m[1]]
            out.append(f | {"filter_type": op, "value": read(m[2]), "exclude": negated != (m[1] == "!=")})
        elif datatype in ("integer", "float", "date") and ":" in rest:
            a, b = map(read, rest.split(":"))
            if datatype == "date" and not a < b:
                raise ValueError(f"the range {rest!r} does not ascend")
            out.append(f | {"filter_type": "range", "value": [a, b]})
        elif datatype in ("integer", "float", "date"):
            out.append(f | {"filter_type": "exact", "value": read(rest)})
        elif rest.startswith("%") and rest.endswith("%") and len(rest) > 1:
            out.append(f | {"filter_type": "contains", "value": rest.strip("%")})
        elif rest.startswith("%"):
            out.append(f | {"filter_type": "endswith", "value": rest[1:]})
        elif rest.endswith("%"):
            out.append(f | {"filter_type": "startswith", "value": rest[:-1]})
        else:
            out.append(f | {"filter_type": "exact", "value": rest})
    return {"orFilter": out}


def group_tree(groups: list[dict]) -> dict:
    """Groups of set filters to a tree: filters within a group AND, groups OR; unset filters are left out, two dates are a range."""
    made = []
    for g in groups:
        own = []
        for f in g.get("filters", []):
            value = f.get("value")
            if value in (None, "", []):
                continue
            if isinstance(value, list) and len(value) == 2 and all(isinstance(v, date) for v in value):
                f = f | {"filter_type": "range", "value": sorted(value)}
            own.append(f)
        if own:
            made.append({"andFilter": own})
    return {"orFilter": made} if made else {}


def in_data_sets(column: Column, names: list[str]) -> Column:
    """Membership of data sets; -Empty- is the one without a name."""
    return F.coalesce(column, F.lit("")).isin(*("" if n == "-Empty-" else n for n in names))


def informative(nt_alt: Column | None = None, aa_alt: Column | None = None) -> Column:
    """Whether a variant's alt holds no N (nucleotides) or X (residues)."""
    return ~F.contains(F.coalesce(nt_alt if nt_alt is not None else aa_alt, F.lit("")), F.lit("N" if nt_alt is not None else "X"))


def quality_gate(calls: DataFrame, entity: str = "sample", longest: int = 2000) -> DataFrame:
    """Calls of the entities without a reference stretch longer than that."""
    bad = calls.groupBy(entity).agg(F.max(F.length("ref")).alias("_longest")).where(F.col("_longest") > longest)
    return calls.join(bad, entity, "left_anti")
