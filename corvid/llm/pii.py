r"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only, row by row, no shuffle. A kind's matches come from
``regexp_extract_all`` and what stands between them from ``split`` on the same pattern;
running sums over their lengths give code-point offsets. Patterns start only at the head of
a run (or where the last match ended) and use possessive repeats, so time stays linear in
the length of a text, and neither a very long word nor very many groups can exhaust the
stack. Each kind runs only on texts that hold a character it needs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the contract. Equal to its forms, with a possessive body; "\G" is where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Added by the method: account numbers that pass mod-97, and identity numbers with fitting words nearby.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"


@dataclass(frozen=True)
class Kind:
    """A kind of personal data; ``base`` spans count whatever their score."""

    name: str
    pattern: str
    #: A cheap test for texts in which the pattern can match at all.
    needs: str
    base: bool
    #: Score of a confirmed match without context, and what fitting words nearby add.
    score: float
    bonus: float
    words: tuple[str, ...] = ()


#: Spans of the method's own kinds count from this score; context is looked for this many code points around, on both sides.
LEAST, AROUND = 0.5, 48
#: Matches that can stand so near: the shortest has five code points.
NEAR = 10
KINDS = (
    Kind("email", EMAIL, "@", True, 0.9, 0.1, ("mail", "contact")),
    Kind("ip", IP, "[0-9]\\.[0-9]", True, 0.6, 0.3, ("ip", "server", "host", "address")),
    Kind("card", CARD, "[0-9][ -]?[0-9]", True, 0.7, 0.3, ("card", "visa", "credit", "payment")),
    Kind("phone", PHONE, "+", True, 0.6, 0.3, ("phone", "call", "tel", "mobile")),
    Kind("iban", IBAN, "[A-Z]{2}[0-9]{2}", False, 0.8, 0.2, ("iban", "account", "bank", "transfer")),
    Kind("ssn", SSN, "[0-9]-[0-9]{2}-[0-9]", False, 0.3, 0.5, ("ssn", "social security", "identity", "tax")),
)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum is a multiple of ten: from the right, every second digit is doubled, its digits added."""
    each = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(each, lambda c: c != ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _mod97(iban: Column) -> Column:
    """The account number with its first four characters last, letters as 10 to 35, is 1 modulo 97."""
    plain = F.replace(iban, F.lit(" "))
    turned = F.concat(F.substring(plain, 5, 100), F.substring(plain, 1, 4))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(chars, F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    """The validator of a kind; false for a match that fails it."""
    if kind == "ip":
        return F.forall(F.split(match, "\\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _mod97(match)
    if kind == "ssn":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _possible(text: Column, kind: Kind) -> Column:
    return F.contains(text, F.lit(kind.needs)) if len(kind.needs) == 1 else text.rlike(kind.needs)


_SPAN = "array<struct<kind:string,start:int,end:int,score:double>>"
#: Matches whose offsets are summed together; running sums then take time linear in the matches.
CHUNK = 512


def _around(kind: Kind, pieces: Column, matches: Column) -> Column:
    """For each match, the AROUND code points before it and after it, other matches included, a space between the two; null for one that its validator rejects.

    Only the few nearest matches can stand that near, so each looks at a bounded number of them.
    """
    spots = F.sequence(F.lit(1), F.size(matches))

    def one(i: Column) -> Column:
        low = F.greatest(i - NEAR, F.lit(1))
        before = F.concat(F.when(low == 1, F.right(F.element_at(pieces, 1), F.lit(AROUND))).otherwise(""), _shift(pieces, matches, low, i - low))
        high = F.least(F.size(matches), i + NEAR)
        after = F.concat(F.left(F.element_at(pieces, i + 1), F.lit(AROUND)), _shift(pieces, matches, i + 1, high - i))
        return F.when(_confirmed(kind.name, F.element_at(matches, i)), F.concat(F.right(before, F.lit(AROUND)), F.lit(" "), F.left(after, F.lit(AROUND))))

    return F.transform(spots, one)


def _shift(pieces: Column, matches: Column, first: Column, n: Column) -> Column:
    """n matches from the first on, each with the start (and, if it is long, the end) of the piece after it."""
    short = lambda p: F.when(F.length(p) > 2 * AROUND, F.concat(F.left(p, F.lit(AROUND)), F.right(p, F.lit(AROUND)))).otherwise(p)
    return F.array_join(F.zip_with(F.slice(matches, first, n), F.slice(pieces, first + 1, n), lambda m, p: F.concat(m, short(p))), "")


def _score(kind: Kind, around: Column) -> Column:
    """A match's score from the text around it."""
    low = F.translate(around, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    fits = low.rlike(f"(?:^|[^a-z0-9_])(?:{'|'.join(kind.words)})") if kind.words else F.lit(False)
    return F.lit(kind.score) + F.when(fits, kind.bonus).otherwise(0.0)


def _counts(kind: Kind, around: Column) -> Column:
    """Whether a match is a span: confirmed and, for kinds that the method adds, likely enough."""
    return around.isNotNull() if kind.base else around.isNotNull() & (_score(kind, around) >= LEAST)


def _running(sizes: Column) -> Column:
    """For each of the sizes, the sum of those before it."""
    zero = F.from_json(F.lit('{"at":0,"out":[]}'), "struct<at:int,out:array<int>>")
    return F.aggregate(sizes, zero, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])


def _spans(kind: Kind, pieces: Column, matches: Column) -> Column:
    """Spans of a kind, in order, from its matches and the pieces between them."""
    plain = F.zip_with(F.slice(pieces, F.lit(1), F.size(matches)), matches, lambda p, m: F.struct(F.length(p).alias("before"), m.alias("match"), (F.length(p) + F.length(m)).alias("size")))
    both = F.zip_with(plain, _around(kind, pieces, matches), lambda x, a: F.struct(x["before"].alias("before"), x["match"].alias("match"), x["size"].alias("size"), a.alias("around")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / CHUNK).cast("int")), lambda i: F.slice(both, i * CHUNK + 1, F.lit(CHUNK)))
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x["size"]))
    starts = F.flatten(F.zip_with(chunks, _running(sums), lambda c, s: F.transform(_running(F.transform(c, lambda x: x["size"])), lambda n: n + s)))
    placed = F.zip_with(both, starts, lambda x, s: F.struct(x["match"].alias("match"), x["around"].alias("around"), (s + x["before"]).alias("start"), (s + x["size"]).alias("end")))
    good = F.filter(placed, lambda x: _counts(kind, x["around"]))
    return F.transform(good, lambda x: F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), _score(kind, x["around"]).alias("score")))


def _cut(text: Column, kind: Kind) -> Column:
    """p: what stands between a kind's matches; m: the matches. Null where there can be none."""
    return F.when(_possible(text, kind), F.struct(F.split(text, kind.pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m")))


def find(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with a column for each kind, ``pii_<kind>``: array of kind, start, end (code points, end exclusive), score.

    A null or empty text has no spans. Spans of one kind do not overlap; those of
    different kinds may. All columns of docs stay; a column of docs with the name of an
    added one is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    # Two projections, so that each pattern's matches are made once and then used by name.
    made = docs.withColumns({f"pii_{k.name}": _cut(whole, k) for k in kinds})
    held = {k: F.col(f"pii_{k.name}") for k in kinds}
    none = F.from_json(F.lit("[]"), _SPAN)
    return made.withColumns({f"pii_{k.name}": F.when(F.size(c["m"]) > 0, _spans(k, c["p"], c["m"])).otherwise(none).cast(_SPAN) for k, c in held.items()})


def redact(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with every span of personal data in ``text`` replaced by its kind in brackets; other texts stay as they are.

    Kinds are replaced in order, each in what the last one left, so overlapping spans go to
    the first kind. A null text stays null.
    """
    out, cut = docs, "__pii_cut"
    while cut in docs.columns:
        cut = f"_{cut}"
    for k in kinds:
        c, whole = F.col(cut), F.col(text)
        shown = c["m"] if k.base else F.zip_with(c["m"], _around(k, c["p"], c["m"]), lambda m, a: F.struct(m.alias("m"), a.alias("a")))
        said = F.zip_with(F.slice(c["p"], F.lit(1), F.size(c["m"])), shown, _replaced(k))
        out = out.withColumn(cut, _cut(whole, k)).withColumn(text, F.when(F.size(c["m"]) > 0, F.concat(F.array_join(said, ""), F.element_at(c["p"], -1))).otherwise(whole))
    return out.select(*[F.col(f"`{x}`") for x in docs.columns])


def _replaced(kind: Kind):
    """What a piece and the match after it become."""
    said = F.lit(f"[{kind.name.upper()}]")
    if kind.base:
        return lambda p, m: F.concat(p, F.when(_confirmed(kind.name, m), said).otherwise(m))
    return lambda p, x: F.concat(p, F.when(_counts(kind, x["a"]), said).otherwise(x["m"]))


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, the number of base spans of each base kind, base_sha256 and spans (see the contract of op7)."""
    found = find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", kinds)
    listed = lambda some: F.array_join(F.transform(F.flatten(F.array(*[F.col(f"pii_{k.name}") for k in some])), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = [k for k in kinds if k.base]
    return found.select("doc_id", *[F.size(f"pii_{k.name}").cast("long").alias(f"n_{k.name}") for k in base], F.sha2(listed(base), 256).alias("base_sha256"), listed(kinds).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every whole text of ``documents``."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: DuckDB's form of the query. Matches are marked in the text (private-use characters), which is then cut at the marks; context is read from the text by offsets.
ORACLE_SQL = r"""
WITH kinds(ord, kind, base, pattern) AS (VALUES
  (1, 'email', true, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+'), (2, 'ip', true, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), (3, 'card', true, '[0-9](?:[ -]?[0-9])+'), (4, 'phone', true, '\+[0-9][ ().0-9-]+[0-9]'),
  (5, 'iban', false, replace('~[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}~|~(?: ~[A-Z0-9]{4}~){2,7}(?: ~[A-Z0-9]{1,3}~)?)', '~', chr(57347))), (6, 'ssn', false, '[0-9-]+')
), d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT r, ord, string_split(regexp_replace(CASE WHEN kind = 'iban' THEN regexp_replace(text, '([A-Za-z0-9]+)', chr(57347) || '\1' || chr(57347), 'g') ELSE text END, pattern, chr(57345) || '\0' || chr(57346), 'g'), chr(57345)) AS parts FROM d, kinds
), parts AS (
  SELECT r, ord, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut WHERE len(parts) > 1
), sized AS (
  SELECT *, replace(CASE WHEN i > 1 THEN split_part(part, chr(57346), 1) END, chr(57347), '') AS m, length(replace(replace(part, chr(57346), ''), chr(57347), '')) AS n FROM parts
), placed AS (
  SELECT r, ord, m, regexp_replace(m, '[^0-9]', '', 'g') AS digits, replace(m, ' ', '') AS plain, sum(n) OVER (PARTITION BY r, ord ORDER BY i) - n AS s FROM sized
), tested AS (
  SELECT *, s + length(m) AS e, CASE ord
    WHEN 1 THEN true
    WHEN 2 THEN len(list_filter(string_split(m, '.'), lambda p: coalesce(try_cast(p AS HUGEINT), 999) > 255)) = 0
    WHEN 3 THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length(digits)), lambda k: CASE WHEN k % 2 = 0 THEN substr(digits, length(digits) - k, 1)::INT ELSE substr(digits, length(digits) - k, 1)::INT * 2 - CASE WHEN substr(digits, length(digits) - k, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0
    WHEN 4 THEN length(digits) BETWEEN 9 AND 15
    WHEN 5 THEN list_reduce(list_concat([0::BIGINT], list_transform(string_split(substr(plain, 5) || substr(plain, 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END::BIGINT)), lambda a, x: CASE WHEN x > 9 THEN a * 100 + x ELSE a * 10 + x END % 97) = 1
    WHEN 6 THEN regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$') END AS fine
  FROM placed WHERE m IS NOT NULL
), kept AS (
  SELECT r, ord, kind, base, s, kind || ':' || s || ':' || e AS span FROM tested JOIN kinds USING (ord) JOIN d USING (r)
  WHERE fine AND (ord < 6 OR regexp_matches(translate(substr(text, greatest(s - 47, 1)::BIGINT, (s - greatest(s - 48, 0))::BIGINT) || ' ' || substr(text, (e + 1)::BIGINT, 48), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '(?:^|[^a-z0-9_])(?:ssn|social security|identity|tax)'))
), told AS (
  SELECT r, count(*) FILTER (WHERE ord = 1) AS n_email, count(*) FILTER (WHERE ord = 2) AS n_ip, count(*) FILTER (WHERE ord = 3) AS n_card, count(*) FILTER (WHERE ord = 4) AS n_phone, string_agg(span, ',' ORDER BY ord, s) FILTER (WHERE base) AS base, string_agg(span, ',' ORDER BY ord, s) AS spans FROM kept GROUP BY r
)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (r)
"""
