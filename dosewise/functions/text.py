"""Text and identifier cleaning as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dosewise.constants import FALLBACK_SLUG, ID_NULL_TOKENS, NULL_TOKENS, WHITE_SPACE


def strip_blank(c: Column) -> Column:
    """Strip Unicode white space; a plain ``trim`` would leave tabs and no-break spaces."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def normalise_name(c: Column) -> Column:
    """Lower-case a column name and reduce everything but letters and digits to single blanks."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def join_key(c: Column) -> Column:
    """Upper-case key without any white space."""
    return F.upper(F.translate(c.cast("string"), WHITE_SPACE, ""))


def clean_id(c: Column) -> Column:
    """Identifier text: stripped, missing words to NULL, one trailing ``.0`` removed.

    Feed it text. A DOUBLE column would already have become ``1.2406792E7``. Plain
    string functions, because filters on the result evaluate it again.
    """
    stripped = strip_blank(c.cast("string"))
    bare = F.when(F.endswith(stripped, F.lit(".0")), F.left(stripped, F.length(stripped) - 2)).otherwise(stripped)
    return F.when(~stripped.isin(ID_NULL_TOKENS), bare)


def usable_id(c: Column) -> Column:
    """True where a cleaned identifier can serve as a join key."""
    return c.isNotNull() & (c != "")


def entity_key(c: Column) -> Column:
    """Case-folded, stripped name used to compare entities."""
    return F.lower(strip_blank(c.cast("string")))


def slug(c: Column) -> Column:
    """Lower-case, runs of anything but ``a-z0-9`` to one underscore, none at the ends."""
    return F.btrim(F.regexp_replace(entity_key(c), "[^a-z0-9]+", "_"), F.lit("_"))


def file_slug(c: Column) -> Column:
    """Slug used for storage names: replaced before lower-casing, never empty."""
    ascii_only = F.regexp_replace(strip_blank(c.cast("string")), "[^A-Za-z0-9]+", "_")
    named = F.lower(F.btrim(ascii_only, F.lit("_")))
    return F.when(named == "", F.lit(FALLBACK_SLUG)).otherwise(named)


def gene_symbol(c: Column) -> Column:
    """Leading symbol of ``SYMBOL (ENTREZ)``, NULL where there is none."""
    return F.nullif(F.regexp_extract(c, r"^([A-Za-z0-9\-]+)", 1), F.lit(""))


def looks_like_feature(c: Column) -> Column:
    """True for names that hold both an opening and a closing parenthesis."""
    return F.contains(c, F.lit("(")) & F.contains(c, F.lit(")"))


def decode_missing(c: Column) -> Column:
    """Words for "missing" in a text column to NULL."""
    return F.when(~c.isin(NULL_TOKENS), c)
