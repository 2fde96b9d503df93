"""Who sent a request. Passwords are never put into a column."""

from pyspark.sql import Column, functions as F

from poolwatch import values as V

_BASE64 = r"^[A-Za-z0-9+/]*={0,2}$"
_BASE64URL = r"^[A-Za-z0-9_-]*$"


def _decoded(col: Column) -> Column:
    """Text behind padded base64; null when it is not that."""
    padded = col.rlike(_BASE64) & (F.length(col) % 4 == 0)
    return F.when(padded, F.unbase64(col).cast("string"))


def _user_part(credentials: Column) -> Column:
    """User before the first colon; null without a colon or without a user."""
    user = F.substring_index(credentials, ":", 1)
    return F.when(credentials.contains(":") & (user != ""), F.make_valid_utf8(user))


def header_user(col: str = "authorization") -> Column:
    """User of an authorization header, scheme basic or bearer in any case."""
    parts = F.split(F.col(col), " ", 2)
    known = F.lower(F.get(parts, F.lit(0))).isin(*V.AUTH_SCHEMES)
    return F.when(known, _user_part(_decoded(F.get(parts, F.lit(1)))))


def explicit_user(user: str = "header_user", has_password: str = "has_password") -> Column:
    """User named in its own header; needs a password header beside it."""
    return F.when(F.col(has_password), F.nullif(F.col(user), F.lit("")))


def message_user(col: str = "user_id") -> Column:
    """User id carried in a message: encoded credentials, else the plain text."""
    return F.nullif(F.coalesce(_user_part(_decoded(F.col(col))), F.col(col)), F.lit(""))


def token_parts(token: str = "token") -> Column:
    return F.size(F.split(F.col(token), r"\."))


def token_part(token: str, part: int) -> Column:
    """A part of a token, base64url without padding, as parsed JSON; null when it is not that."""
    raw = F.get(F.split(F.col(token), r"\."), F.lit(part))
    padded = F.rpad(raw, F.ceil(F.length(raw) / 4).cast("int") * 4, F.lit("="))
    text = F.unbase64(F.translate(padded, "-_", "+/")).cast("string")
    proper = raw.rlike(_BASE64URL) & (F.length(raw) % 4 != 1)
    return F.try_parse_json(F.when(proper, text))


def token_ok(parts: str, head: str) -> Column:
    alg = F.try_variant_get(F.col(head), "$.alg", "string")
    return (F.col(parts) == 3) & alg.isin(*V.TOKEN_ALGORITHMS)


def _is_text(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _claim_path(name: str) -> str:
    """Path of a claim by its whole name, which may hold dots and slashes."""
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise ValueError(f"a claim name with both kinds of quotes: {name}")
    return f"$[{quote}{name}{quote}]"


def claimed_user(claims: str, claim: str = V.USER_CLAIM) -> Column:
    """User claim of a token whose signature nobody checked; must be non-empty text."""
    value = F.try_variant_get(F.col(claims), _claim_path(claim or V.USER_CLAIM), "variant")
    return F.when(_is_text(value), F.nullif(F.try_variant_get(value, "$", "string"), F.lit("")))


def claimed_groups(claims: str, claim: str = V.GROUPS_CLAIM) -> Column:
    """Text elements of the groups claim; empty when the claim is no list."""
    items = F.try_variant_get(F.col(claims), _claim_path(claim or V.GROUPS_CLAIM), "array<variant>")
    texts = F.transform(F.filter(items, _is_text), lambda v: F.try_variant_get(v, "$", "string"))
    return F.coalesce(texts, F.array().cast("array<string>"))
