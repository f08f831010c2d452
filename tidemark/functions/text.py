"""Names, identifiers and typed values from text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.core import Name, as_column

#: What counts as no value, true tokens, and accented letters with their plain forms.
NULLISH = ("", "NULL", "NA", "N/A", "-", "NAO INFORMADO")
TRUE_TOKENS = ("S", "SIM", "TRUE", "1", "Y", "YES")
ACTIVE_TOKENS = ("FUNCIONAMENTO NORMAL", "EM FUNCIONAMENTO", "ATIVO")
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçñ"
PLAIN = "aaaaaeeeeiiiiooooouuuucn"
#: Weights of the two check digits of a 14-digit company number.
WEIGHTS_1 = (5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)
WEIGHTS_2 = (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2)


def name_norm(c: Name) -> Column:
    """Lower-case, without accents, white space collapsed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(as_column(c)), ACCENTED, PLAIN), r"\s+", " "))


def name_core(norm: Name, boilerplate: tuple[str, ...]) -> Column:
    """A normalised name without boilerplate words, if at least two words are left."""
    words = F.filter(F.split(as_column(norm), " "), lambda w: ~w.isin(*boilerplate) if boilerplate else F.lit(True))
    return F.when(F.size(words) >= 2, F.array_join(words, " ")).otherwise(as_column(norm))


def trigrams(norm: Name) -> Column:
    """The set of trigrams of each word, padded by two blanks before and one after."""
    words = F.filter(F.split(as_column(norm), "[^a-z0-9]+"), lambda w: F.length(w) > 0)
    grams = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3)))))
    return F.array_distinct(grams)


def similarity(a: Name, b: Name) -> Column:
    """Trigrams in common over trigrams in either, of two trigram sets; null sets give null."""
    a, b = as_column(a), as_column(b)
    both = F.size(F.array_intersect(a, b))
    return both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0))


def digits(c: Name) -> Column:
    return F.regexp_replace(as_column(c), r"\D", "")


def company_number_ok(c: Name) -> Column:
    """Whether 14 digits carry right check digits (weights modulo 11); repeated digits don't."""
    d = digits(c)
    at = lambda i: F.substring(d, i + 1, 1).cast("int")

    def check(weights: tuple[int, ...]) -> Column:
        rest = sum((at(i) * w for i, w in enumerate(weights)), F.lit(0)) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest)

    sound = (F.length(d) == 14) & ~d.rlike(r"^(\d)\1{13}$")
    return F.coalesce(sound & (check(WEIGHTS_1) == at(12)) & (check(WEIGHTS_2) == at(13)), F.lit(False))


def clean(c: Name) -> Column:
    """Trimmed text; null where it stands for no value."""
    t = F.trim(as_column(c))
    return F.when(~F.upper(F.translate(F.lower(t), ACCENTED, PLAIN)).isin(*NULLISH), t)


def company_number(c: Name) -> Column:
    """The digits, padded with zeros to fourteen; null without a digit."""
    d = digits(clean(c))
    return F.when(F.length(d) > 0, F.when(F.length(d) < 14, F.lpad(d, 14, "0")).otherwise(d))


def company_code(c: Name) -> Column:
    """The digits without leading zeros; null without any."""
    d = F.regexp_replace(digits(clean(c)), "^0+", "")
    return F.when(F.length(d) > 0, d)


def to_decimal(c: Name, scale: int = 6) -> Column:
    """A number, perhaps after a currency mark, with decimal comma (and dots between thousands) or with decimal point;
    null if it is neither."""
    t = F.trim(F.regexp_replace(F.regexp_replace(clean(c), " ", ""), "^[R$]+", ""))
    comma = F.regexp_replace(F.regexp_replace(t, r"\.", ""), ",", ".")
    return F.when(t.contains(","), comma).otherwise(t).try_cast(f"decimal(28,{scale})")


def to_int(c: Name) -> Column:
    """A whole number: dots stand between thousands, what follows a comma is cut."""
    t = F.regexp_replace(F.regexp_replace(clean(c), r"\.", ""), ",", ".")
    return t.try_cast("decimal(28,6)").try_cast("bigint")


def to_bool(c: Name) -> Column:
    t = F.upper(clean(c))
    return F.when(t.isNotNull(), t.isin(*TRUE_TOKENS))


def to_date(c: Name) -> Column:
    """The first of four formats that fits."""
    t = clean(c)
    tried = [F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f)).cast("date")) for p, f in ((r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{2}/\d{2}/\d{4}$", "dd/MM/yyyy"), (r"^\d{8}$", "yyyyMMdd"), (r"^\d{2}/\d{2}/\d{2}$", "dd/MM/yy"))]
    return F.coalesce(*tried)


def row_hash(columns: list[str]) -> Column:
    """SHA-256 of k=v in the order of names, joined by the unit separator; nulls are empty."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(columns)]
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def json_field(c: Name, key: str) -> Column:
    return F.get_json_object(as_column(c), f"$.{key}")


def is_active(status: Name) -> Column:
    """Whether a registry's status names a fund in operation; every other status is not; null or blank is unknown."""
    t = F.upper(F.trim(as_column(status)))
    named = F.lit(False)
    for token in ACTIVE_TOKENS:
        named = named | F.contains(t, F.lit(token))
    return F.when(t != "", named)
