"""Identifiers: tokens, stems, generic names, code words and shingles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GENERIC = frozenset(
    "as_mut as_ref as_str borrow borrow_mut build capacity clear clone clone_from cmp collect create default deref deref_mut drop eq err expect extend filter fmt from get get_mut hash"
    " index index_mut init insert into into_iter is_empty iter len load lock map ne new next ok parse partial_cmp pop push read recv remove reserve resize retain save send set to_owned"
    " to_string to_vec truncate try_from try_into unwrap update with_capacity write".split()
)
_STEM_SUFFIXES = ("dto", "handler", "model", "repo", "service", "view")
#: A stem group with a name that ends so is a family, not a misuse.
FAMILY_SUFFIXES = ("dto", "handler", "model", "repo", "service")
_SKIPPED_LEADS = sorted("a async class const crate def enum export extern fn function impl interface let mod mut pub return self static struct super the type unsafe use".split())
IDENTIFIER = "^[A-Za-z_][A-Za-z0-9_]*$"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once: lambdas would otherwise compute an inlined column for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokenize(name: Column) -> Column:
    """Lower-case words of an identifier, split at separators, digits and camel humps; get, set, the, a go."""
    parts = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit("[0-9]+|[a-z]+|[A-Z][a-z]+|[A-Z]+(?![a-z])"), F.lit(0))
    return F.filter(F.transform(parts, F.lower), lambda t: ~t.isin("get", "set", "the", "a"))


def stem(tokens: Column) -> Column:
    """The last token if it names a role (model, service, ...), else the first; '' for no tokens."""
    last = F.element_at(tokens, -1)
    return F.when(F.size(tokens) == 0, "").when((F.size(tokens) > 1) & ~last.isin(*_STEM_SUFFIXES), F.get(tokens, F.lit(0))).otherwise(last)


def is_generic(name: Column) -> Column:
    return F.lower(name).isin(*sorted(GENERIC))


def code_tokens(body: Column) -> Column:
    """Runs of letters, digits and '_', lower-cased in ASCII, without self, return, the, a."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    found = F.regexp_extract_all(F.translate(F.coalesce(body, F.lit("")), upper, lower), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return F.filter(found, lambda t: ~t.isin("self", "return", "the", "a"))


def shingles(tokens: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` tokens; all tokens as one if there are fewer; none for none."""

    def made(t: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(t) - (size - 1)), lambda i: F.array_join(F.slice(t, i, size), " "))
        short = F.when(F.size(t) == 0, F.array().cast("array<string>")).otherwise(F.array(F.array_join(t, " ")))
        return F.when(F.size(t) >= size, F.array_distinct(runs)).otherwise(short)

    return let(tokens, made)


def bucket_key(name: Column, tokens: Column) -> Column:
    """The first token that is no keyword, else the name; twelve characters of it."""
    lead = F.get(F.filter(tokens, lambda t: ~t.isin(*_SKIPPED_LEADS)), F.lit(0))
    return F.substring(F.coalesce(lead, name), 1, 12)


def contains_identifier(text: Column, identifier: Column) -> Column:
    """The identifier occurs in the text with no ASCII identifier character on either side; false for ''."""
    quoted = F.concat(F.lit(r"(?<![A-Za-z0-9_])\Q"), F.replace(identifier, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![A-Za-z0-9_])"))
    return (identifier != "") & F.regexp_like(F.coalesce(text, F.lit("")), quoted)


def jaccard(a: Column, b: Column, both_empty: float) -> Column:
    """Jaccard similarity of two arrays as sets; both_empty where both are, 0 where one is."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(both_empty)).when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)
