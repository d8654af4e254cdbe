"""Column expressions on sequences, labels, dates and typed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "TCAG"
# Residues of the standard genetic code, codons in the order of BASES.
RESIDUES = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: RESIDUES[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}
# Bases that an ambiguity code stands for, the codes themselves included where searches accept them.
NT_CODES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AGR", "Y": "CTY", "S": "GCS", "W": "ATW", "K": "GTK", "M": "ACM", "B": "CGTB", "D": "AGTD", "H": "ACTH", "V": "ACGV", "N": "ACGTRYSWKMBDHVN", "n": "N"}
# Residues that an amino-acid code stands for.
AA_CODES = {a: a for a in "ARNDCQEGHILKMFPSTWYVUO"} | {"B": "DNB", "Z": "EQZ", "J": "ILJ", "Φ": "VILFWYMΦ", "Ω": "FWYHΩ", "Ψ": "VILMΨ", "π": "PGASπ", "ζ": "STHNQEDKRζ", "+": "KRH+", "-": "DE-", "X": "ARNDCQEGHILKMFPSTWYVUOBZJΦΩΨπζ+-X", "x": "X"}
TRUE_WORDS, FALSE_WORDS = ("y", "yes", "t", "true", "on", "1"), ("n", "no", "f", "false", "off", "0")
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "dd.MM.yyyy", "M/d/yyyy", "dd-MMM-yyyy", "d MMM yyyy", "MMM d, yyyy", "yyyyMMdd")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(values: dict, key: Column) -> Column:
    """The value of a literal map, null where the key is unknown."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def harmonised(seq: Column | str) -> Column:
    """Upper case, trimmed; '.' as N, U as T, gaps removed."""
    return F.translate(F.upper(F.trim(col(seq))), ".U-", "NT")


def reference_sequence(seq: Column | str) -> Column:
    """Upper case, trimmed, U as T; gaps stay."""
    return F.replace(F.upper(F.trim(col(seq))), F.lit("U"), F.lit("T"))


def sequence_hash(seq: Column | str) -> Column:
    return F.sha2(F.upper(col(seq)).cast("binary"), 256)


def deleted(alt: Column | str) -> Column:
    return F.trim(F.coalesce(col(alt), F.lit(""))) == ""


def deletion_label(start: Column | str, end: Column | str) -> Column:
    first, last = (col(start) + 1).cast("string"), col(end).cast("string")
    return F.when(col(end) - col(start) == 1, F.concat(F.lit("del:"), first)).otherwise(F.concat(F.lit("del:"), first, F.lit("-"), last))


def nt_label(ref="ref", start="start", end="end", alt="alt", frameshift=None) -> Column:
    """A435G, A435GTT, del:7, del:7-9; with *fs behind frameshifts."""
    label = F.when(deleted(alt), deletion_label(start, end)).otherwise(F.concat(col(ref), col(end).cast("string"), col(alt)))
    return label if frameshift is None else F.concat(label, F.when(col(frameshift).cast("boolean"), "*fs").otherwise(""))


def aa_label(gene="gene", ref="ref", start="start", end="end", alt="alt") -> Column:
    return F.concat(col(gene), F.lit(":"), nt_label(ref, start, end, alt))


def nt_frameshift(ref: Column | str, alt: Column | str) -> Column:
    return F.pmod(F.length(F.trim(col(alt))) - F.length(col(ref)), F.lit(3)) != 0


def aa_frameshift(alt: Column | str) -> Column:
    return F.contains(col(alt), F.lit("*")) | (F.length(col(alt)) > 1)


def residue(codon: Column | str) -> Column:
    """Residue of a codon, * for stops; of an ambiguous codon the residue that all its readings share, else X; null for a partial one."""
    codon = col(codon)
    bases = lambda i: F.split(F.coalesce(lookup({k: v.replace(k, "") if k not in "ACGTn" else v for k, v in NT_CODES.items() if k != "n"}, F.substring(codon, i, 1)), F.lit("?")), "")
    real = lambda i: F.filter(bases(i), lambda b: b.isin(*"ACGT"))
    readings = F.flatten(F.transform(real(1), lambda a: F.flatten(F.transform(real(2), lambda b: F.transform(real(3), lambda c: lookup(CODONS, F.concat(a, b, c)))))))
    plain = lookup(CODONS, codon)
    several = F.array_distinct(readings)
    return F.when(F.length(codon) != 3, F.lit(None)).when(plain.isNotNull(), plain).when(F.size(several) == 1, several[0]).otherwise("X")


def translated(seq: Column | str) -> Column:
    """Residues of whole codons."""
    seq = col(seq)
    n = F.floor(F.length(seq) / 3).cast("int")
    codons = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(seq, i * 3 + 1, F.lit(3)))
    return F.when(n < 1, "").otherwise(F.array_join(F.transform(codons, lambda c: F.coalesce(lookup(CODONS, c), F.lit("X"))), ""))


def reverse_complement(seq: Column | str) -> Column:
    return F.reverse(F.translate(col(seq), "ACGTRYSWKMBDHV", "TGCAYRSWMKVHDB"))


def annotation_text(ontology: Column | str, impact: Column | str, region: Column | str | None = None) -> Column:
    return F.trim(F.concat_ws(" ", col(ontology), col(impact), *([] if region is None else [F.coalesce(col(region), F.lit(""))])))


def rendered_profile(profile: Column | str, annotations: bool = True) -> Column:
    """acc(label(anno; anno), label) of array<struct<name, items: array<struct<label, annotations>>>>."""
    item = lambda x: F.when((F.size(x["annotations"]) > 0) & F.lit(annotations), F.concat(x["label"], F.lit("("), F.array_join(x["annotations"], "; "), F.lit(")"))).otherwise(x["label"])
    return F.array_join(F.transform(col(profile), lambda p: F.concat(p["name"], F.lit("("), F.array_join(F.transform(p["items"], item), ", "), F.lit(")"))), ", ")


def split_list(text: Column | str) -> Column:
    """Items between commas, semicolons and white space."""
    return F.filter(F.split(col(text), r"[,;\s]+"), lambda x: x != "")


def header_id(header: Column | str) -> Column:
    return F.regexp_extract(col(header), r"^>?\s*([^\s|]+)", 1)


def molecule_tag(header: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(header), r"\[molecule=([^\]]+)\]", 1), F.lit(""))


def parsed_bool(text: Column | str) -> Column:
    """Whether a word says yes or no; null for any other."""
    word = F.lower(F.trim(col(text)))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def parsed_date(text: Column | str, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """The first format that reads the whole text; null where none does."""
    own = F.nullif(F.trim(col(text)), F.lit(""))
    return reduce(lambda a, b: F.coalesce(a, b), [F.try_to_timestamp(own, F.lit(f)).cast("date") for f in formats])


def completed_date(text: Column | str) -> Column:
    """YYYY and YYYY-MM as their first day; '' where no date results."""
    own = F.trim(col(text))
    whole = F.when(own.rlike("^[0-9]{4}$"), F.concat(own, F.lit("-01-01"))).when(own.rlike("^[0-9]{4}-[0-9]{2}$"), F.concat(own, F.lit("-01"))).when(own.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), own)
    return F.coalesce(whole.try_cast("date").cast("string"), F.lit(""))


def week_start(day: Column | str) -> Column:
    """The Monday of a date's week."""
    return F.date_trunc("week", col(day)).cast("date")


def week_label(day: Column | str) -> Column:
    """YYYY-Www by the ISO calendar."""
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), col(day)), F.weekofyear(col(day)))


def typed(text: Column | str, datatype: str, default: str | None = None) -> Column:
    """A text as its property's type, with the default where it is missing; null where it can't be read."""
    kinds = {"value_integer": "bigint", "value_float": "double", "value_date": "date", "value_text": "string", "value_varchar": "string", "value_zip": "string", "value_blob": "string"}
    value = F.coalesce(F.nullif(F.trim(col(text)), F.lit("")), F.lit(default))
    return value.try_cast(kinds[datatype])


def first_value(*columns: Column | str) -> Column:
    """The first value that is not null, as text: zero and empty are values."""
    return F.coalesce(*(col(c).cast("string") for c in columns))


def json_field(text: Column | str, field: str) -> Column:
    """A field of the first object of a JSON array (or of a JSON object)."""
    return F.coalesce(F.get_json_object(col(text), f"$[0].{field}"), F.get_json_object(col(text), f"$.{field}"))


def percent_text(n: Column | str, total: Column | str) -> Column:
    return F.format_string("%d (%.2f%%)", col(n), F.when(col(total) == 0, 0.0).otherwise(F.round(100.0 * col(n) / col(total), 2)))


def natural_key(text: Column | str, first: str | None = None) -> Column:
    """Sorts numbers within names by value; `first` sorts before all."""
    parts = F.transform(F.regexp_extract_all(F.lower(col(text)), F.lit("[0-9]+|[^0-9]+"), 0), lambda p: F.when(p.rlike("^[0-9]+$"), F.lpad(p, 12, "0")).otherwise(p))
    key = F.array_join(parts, "")
    return key if first is None else F.when(col(text) == first, F.lit("")).otherwise(key)
