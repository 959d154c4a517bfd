"""Surrogates for personal data: keyed, of the same kind and shape, distinct and consistent.

E-mail addresses, IP addresses, phone and card numbers, national ids, account numbers, access keys,
secrets and names after a title are found by pattern; a name found once in a document is found
wherever it stands there. Each entity has a canonical form (digits without separators, lower-case
address, a name's lower-case word), and each canonical form one surrogate, drawn from a keyed hash:

* digits become digits, letters and marks become such of the same script and case (of a script that
  is not listed: Latin letters, ASCII digits, accents), separators stay; a secret of separators only
  becomes letters and digits;
* cards that pass the check-digit test still pass it, and keep their first digit;
* names are made of syllables of the name's script, given names with an ending of the gender that
  the title tells.

So the same entity gets the same surrogate in every document and format (coreference). Two checks
over all distinct entities of the table see to it that entities stay apart: surrogates that two
entities share, and surrogates that are an entity of the table themselves, are drawn anew until
there are none. Later draws of names, and those of addresses and secrets whose shape leaves too few
choices, are longer.

All of it is built-in functions. Only documents with an entity are joined and rebuilt.

Cases: null and empty texts pass as they are; rows that repeat key and text are rebuilt alike; ties
between colliding entities go to the one that sorts first; extra columns are kept; an empty table
gives an empty result.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from consentry.llm.common import prepare
from consentry.sources.staging import lookup, stage

# What is looked for.
OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
IP = rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)"
EMAIL = (r"(?<![\p{L}\p{M}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+-]*+@"
         r"[\p{L}\p{M}\p{N}-]+(?:\.[\p{L}\p{M}\p{N}-]+)+")
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)"
CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"
NATIONAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
ACCOUNT = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
ACCESS_KEY = r"(?<![\p{L}\p{N}])AKIA[0-9A-Z]{16}(?![\p{L}\p{N}])"
BEFORE_SECRET = "password=|passwd=|secret=|api_key=|token=|password: |token = \""
SECRET = rf"(?<={BEFORE_SECRET})[\p{{L}}\p{{M}}\p{{N}}_+/.-]{{6,}}+"
HEX = r"(?<![\p{L}\p{N}])[0-9a-f]{32,64}(?![\p{L}\p{N}])"
ENTITY = "|".join((EMAIL, ACCESS_KEY, ACCOUNT, HEX, SECRET, IP, PHONE, NATIONAL, CARD))

MASCULINE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Signor", "г-н", "Господин", "Κύριος", "Κος")
FEMININE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "г-жа",
            "Госпожа", "Κυρία", "Κα")
TITLED = (rf"(?<!\p{{L}})({'|'.join((*MASCULINE, *FEMININE))})\.?[ ]"
          r"(\p{Lu}\p{L}+)(?:[ ](\p{Lu}\p{L}+))?")
#: A cheap test that every text with an entity passes: the kinds that need neither a digit nor an @ by
#: their own patterns.
HINT = rf"[0-9@]|{BEFORE_SECRET}|AKIA|{HEX}|{TITLED}"

SYLLABLES = {
    "Latin": "ba be bo da de do fa fe ga go ka ke la le lo ma me mi na ne no ra re ro sa se ta te "
             "va ve wi zo",
    "Cyrillic": "ба бе бо да де до фа га го ка ке ла ле ло ма ме ми на не но ра ре ро са се та те "
                "ва ве ви зо лу ру",
    "Greek": "βα βε βο δα δε δο φα γα γο κα κε λα λε λο μα με μι να νε νο ρα ρε ρο σα σε τα τε "
             "βι ζο λυ ρυ πα",
}
ENDINGS = {
    ("Latin", "m"): "rus nor ven ric", ("Latin", "f"): "lia nina rella sia",
    ("Latin", "s"): "ner man sen rez",
    ("Cyrillic", "m"): "слав мир рил тан", ("Cyrillic", "f"): "лия нина рина сия",
    ("Cyrillic", "s"): "ненко рчук лян рез",
    ("Greek", "m"): "ρος νος τος λης", ("Greek", "f"): "λια νη ρα σια",
    ("Greek", "s"): "δης κος ρας λος",
}
LETTERS = {
    "Latin": "abcdefghijklmnopqrstuvwxyz", "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя",
    "Greek": "αβγδεζηθικλμνξοπρστυφχψω", "Armenian": "աբգդեզէըթժիլխծկհձղճմնշոչպջռսվտրցփքօֆ",
}
#: Blocks of scripts without case, by their first and last letter, mark or digit.
BLOCKS = {
    "Hebrew": (0x0591, 0x05EA), "Arabic": (0x0610, 0x06FF), "Devanagari": (0x0900, 0x097F),
    "Bengali": (0x0980, 0x09FE), "Gurmukhi": (0x0A01, 0x0A75), "Gujarati": (0x0A81, 0x0AFF),
    "Oriya": (0x0B01, 0x0B71), "Tamil": (0x0B82, 0x0BEF), "Telugu": (0x0C00, 0x0C6F),
    "Kannada": (0x0C80, 0x0CEF), "Malayalam": (0x0D00, 0x0D7F), "Sinhala": (0x0D81, 0x0DF3),
    "Thai": (0x0E01, 0x0E59), "Lao": (0x0E81, 0x0ED9), "Tibetan": (0x0F00, 0x0FBC),
    "Myanmar": (0x1000, 0x109D), "Georgian": (0x10D0, 0x10F0), "Ethiopic": (0x1200, 0x135A),
    "Khmer": (0x1780, 0x17E9), "Mongolian": (0x1810, 0x1878), "Hiragana": (0x3042, 0x3093),
    "Katakana": (0x30A2, 0x30F3), "Bopomofo": (0x3105, 0x312F), "Hangul": (0xAC00, 0xD7A3),
    "Han": (0x4E00, 0x4EFF),
}
ACCENTS = "\u0300\u0301\u0302\u0303\u0308"
DRAWS = 40
#: From this draw on, addresses and secrets grow by a character a draw.
LONGER = 8


def _kind(entity: Column) -> Column:
    """What an entity that is no name is."""
    kinds = (
        ("email", entity.contains("@")), ("phone", entity.startswith("+")),
        ("ip", entity.rlike(rf"^{OCTET}(\.{OCTET}){{3}}$")),
        ("national", entity.rlike(r"^\d{3}-\d{2}-\d{4}$")), ("card", entity.rlike(r"^[\d -]+$")),
        ("key", entity.rlike(r"^AKIA[0-9A-Z]{16}$")),
        ("account", entity.rlike(r"^[A-Z]{2}\d{2}( ?[A-Z0-9]+)+$")),
        ("hex", entity.rlike(r"^[0-9a-f]+$")),
    )
    out = F.when(F.lit(False), F.lit(None))
    for name, test in kinds:
        out = out.when(test, F.lit(name))
    return out.otherwise(F.lit("secret"))


_NUMBERS = ("phone", "card", "national")


def _canonical(kind: Column, entity: Column) -> Column:
    return (
        F.when(kind.isin(*_NUMBERS), F.regexp_replace(entity, r"\D", ""))
        .when(kind == "account", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind.isin("email", "given_m", "given_f", "surname"), F.lower(entity))
        .otherwise(entity))


def _byte(stream: Column, k: Column | int) -> Column:
    """The ``k``-th byte of a stream of hex digits, from 0."""
    at = (F.lit(k) if isinstance(k, int) else k) % 128
    return F.conv(F.substring(stream, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: str | list[str], at: Column) -> Column:
    options = values.split() if isinstance(values, str) else values
    return F.element_at(F.array(*map(F.lit, options)), at % len(options) + 1)


def _classes() -> list[tuple[str, str]]:
    """Patterns of a character and what may stand for it; the first that fits holds."""
    out = [(r"^\d$", "0123456789")]
    for script, letters in LETTERS.items():
        out.append((rf"^(?=\p{{Ll}})\p{{Is{script}}}$", letters))
        out.append((rf"^(?=\p{{Lu}})\p{{Is{script}}}$", letters.upper()))
    for script, (first, last) in BLOCKS.items():
        here = rf"[\p{{Is{script}}}\x{{{first:X}}}-\x{{{last:X}}}]"
        # A byte picks one; of the many syllables of Hangul, those spread over the block.
        step = max(1, (last - first + 1) // 256)
        block = [chr(c) for c in range(first, last + 1, step)]
        for major in ("L", "M", "Nd"):
            chars = [c for c in block if unicodedata.category(c).startswith(major)]
            if major == "Nd":
                chars = chars[:10]
            if len(chars) > 1:
                out.append((rf"^(?=\p{{{major}}}){here}$", "".join(chars[:256])))
    latin = LETTERS["Latin"]
    return [*out, (r"^[\p{Lu}\p{Lt}]$", latin.upper()), (r"^\p{L}$", latin),
            (r"^\p{N}$", "0123456789"), (r"^\p{M}$", ACCENTS)]


def _reshaped(canon: Column, stream: Column) -> Column:
    """Every digit, letter and mark of ``canon`` exchanged for one of its class; if it has none of
    these, every character for a letter or digit."""
    def options(c: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None))
        for pattern, chars in _classes():
            out = out.when(c.rlike(pattern), F.lit(chars))
        out = out.when(~canon.rlike(r"[\p{L}\p{M}\p{N}]"), F.lit(LETTERS["Latin"] + "0123456789"))
        return F.struct(c.alias("c"), out.alias("options"))

    def one(x: Column, k: Column) -> Column:
        at = _byte(stream, k) % F.length(x["options"]) + 1
        return F.coalesce(F.substring(x["options"], at, F.lit(1)), x["c"])

    return F.array_join(F.transform(F.transform(F.split(canon, ""), options), one), "")


def _check_sum(digits: Column) -> Column:
    """The check-digit sum of card numbers; 0 modulo 10 is valid."""
    def add(total: Column, digit: Column) -> Column:
        return total + digit

    def weighted(c: Column, k: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weighted), F.lit(0), add)


def _name(canon: Column, kind: Column, stream: Column, draw: Column) -> Column:
    """Two syllables and an ending; from the third draw on a syllable more with each draw, so the
    space grows past any number of names."""
    out = None
    # The fourth byte is the ending's.
    places = F.transform(
        F.sequence(F.lit(0), F.greatest(draw, F.lit(1))), lambda k: k + (k > 2).cast("int"))

    def syllables(script: str) -> Column:
        return F.array_join(
            F.transform(places, lambda k: _pick(SYLLABLES[script], _byte(stream, k))), "")

    for script in ("Cyrillic", "Greek", "Latin"):
        for code, test in (("m", kind == "given_m"), ("f", kind == "given_f"), ("s", F.lit(True))):
            made = F.concat(
                syllables(script), _pick(ENDINGS[script, code], _byte(stream, 3)))
            fits = test & (F.lit(True) if script == "Latin" else canon.rlike(rf"\p{{Is{script}}}"))
            out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def _drawn(kind: Column, canon: Column, draw: Column, key: str) -> Column:
    """The canonical surrogate of draw number ``draw``."""
    seed = F.concat_ws("\u0001", F.lit(key), kind, draw.cast("string"), canon)
    stream = F.concat(*[F.sha2(F.concat(F.lit(str(k)), seed), 512) for k in range(2)])
    shaped = _reshaped(canon, stream)
    kept = F.concat(F.substring(canon, 1, 1), F.substring(shaped, F.lit(2), F.length(canon) - 1))
    body = F.substring(kept, F.lit(1), F.length(canon) - 1)
    check = (10 - _check_sum(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.when(_check_sum(canon) % 10 == 0, F.concat(body, check.cast("string"))).otherwise(kept)
    more = F.substring(F.sha2(F.concat(F.lit("more"), seed), 512), F.lit(1), F.greatest(
        draw - LONGER + 1, F.lit(0)))
    octets = [(_byte(stream, k) % 223 + 1).cast("string") for k in range(4)]
    return (
        F.when(kind.isin("given_m", "given_f", "surname"), _name(canon, kind, stream, draw))
        .when(kind == "hex", F.substring(stream, F.lit(1), F.length(canon)))
        .when(kind == "ip", F.concat_ws(".", *octets)).when(kind == "card", card)
        .when(kind == "phone", kept)
        .when(kind == "key", F.concat(F.lit("AKIA"), F.substring(shaped, 5, 16)))
        .when(kind == "account", F.concat(
            F.substring(canon, 1, 2), F.substring(shaped, F.lit(3), F.length(canon) - 2)))
        .otherwise(F.concat(more, shaped)))


def _formatted(kind: Column, entity: Column, surrogate: Column) -> Column:
    """``surrogate`` in the format of ``entity``."""
    def put(state: Column, c: Column) -> Column:
        takes = c.rlike(r"^[\p{L}\p{N}]$")
        new = F.substring(surrogate, state["at"], F.lit(1))
        return F.struct(
            F.concat(state["out"], F.when(takes, new).otherwise(c)).alias("out"),
            (state["at"] + takes.cast("int")).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    spaced = F.aggregate(F.split(entity, ""), start, put)["out"]
    whole = (
        F.when((entity == F.upper(entity)) & (F.length(entity) > 1), F.upper(surrogate))
        .otherwise(surrogate))
    return (
        F.when(kind.isin(*_NUMBERS, "account"), spaced).when(kind == "email", whole)
        .when(kind.isin("given_m", "given_f", "surname"), F.when(
            (entity == F.upper(entity)) & (F.length(entity) > 1), F.upper(surrogate))
            .otherwise(F.initcap(surrogate)))
        .otherwise(surrogate))


def _named(text: str) -> tuple[Column, Column]:
    """Names after titles, as words, and what each is."""
    title, first, second = (F.regexp_extract_all(F.col(text), F.lit(TITLED), k) for k in (1, 2, 3))
    triples = F.arrays_zip(title.alias("t"), first.alias("a"), second.alias("b"))
    words = F.flatten(F.transform(triples, lambda x: F.array(x["a"], x["b"])))
    given = lambda x: F.when(x["t"].isin(*FEMININE), "given_f").otherwise("given_m")
    kinds = F.flatten(F.transform(triples, lambda x: F.array(
        F.when(x["b"] == "", F.lit("surname")).otherwise(given(x)), F.lit("surname"))))
    return words, kinds


def entities(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with ``pieces`` (the text between entities), ``found`` and ``kinds``."""
    words, kinds = _named(text)
    docs = docs.withColumn("names", words).withColumn("name_kinds", kinds)
    real = F.array_distinct(F.filter("names", lambda w: w != ""))
    either = F.concat(
        F.lit(ENTITY + r"|(?<!\p{L})(?:"), F.array_join(real, "|"), F.lit(r")(?!\p{L})"))
    docs = docs.withColumn("pattern", F.when(F.size(real) > 0, either).otherwise(F.lit(ENTITY)))
    docs = docs.withColumn("found", F.regexp_extract_all(F.col(text), F.col("pattern"), F.lit(0)))
    docs = docs.withColumn("pieces", F.split(F.col(text), F.col("pattern"), -1))

    def kind(entity: Column) -> Column:
        at = F.array_position(F.col("names"), entity).cast("int")
        return F.when(at > 0, F.element_at("name_kinds", F.when(at > 0, at).otherwise(1))).otherwise(
            _kind(entity))

    return docs.withColumn("kinds", F.transform("found", kind)).drop(
        "names", "name_kinds", "pattern")


def surrogates(found: DataFrame, key: str) -> DataFrame:
    """``kind`` and ``canon`` of all entities to ``kind``, ``canon`` and ``surrogate``."""
    drawn = stage(found.select("kind", "canon").distinct().withColumn("draw", F.lit(0)))
    for _ in range(DRAWS):
        made = drawn.withColumn(
            "surrogate", _drawn(F.col("kind"), F.col("canon"), F.col("draw"), key))
        group = F.when(F.col("kind").isin("given_m", "given_f"), "given").otherwise(F.col("kind"))
        same = Window.partitionBy("group", "surrogate").orderBy("draw", "kind", "canon")
        made = made.withColumn("group", group).withColumn("place", F.row_number().over(same))
        real = drawn.select(
            F.col("kind").alias("k"), F.col("canon").alias("c"), F.lit(True).alias("real"))
        made = stage(made.join(
            real, (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("c")), "left")
            .withColumn("again", F.col("real").isNotNull() | (F.col("place") > 1))
            .select("kind", "canon", "draw", "surrogate", "again"))
        if made.filter("again").isEmpty():
            return made.select("kind", "canon", "surrogate")
        drawn = made.select(
            "kind", "canon", (F.col("draw") + F.col("again").cast("int")).alias("draw"))
    raise ValueError(f"surrogates still collide after {DRAWS} draws; is a kind's space too small?")


def replace(
    docs: DataFrame, *, key: str, doc_key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``row`` (the document), ``clean`` (its text with surrogates) and ``n_entities``.

    ``key`` is the secret that surrogates depend on.
    """
    prepare(docs.sparkSession)
    rows = docs.select(
        F.struct("*").alias("row"), F.col(doc_key).alias("id"), F.col(text).alias("text"),
        F.xxhash64(text).alias("hash"))
    hint = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    hinted = stage(
        entities(rows.filter(hint).select("id", "hash", "text"), "text").drop("text")
        .filter(F.size("found") > 0))
    each = hinted.select("id", "hash", F.posexplode(F.arrays_zip("found", "kinds")).alias("at", "e"))
    each = each.select(
        "id", "hash", "at", F.col("e.found").alias("entity"), F.col("e.kinds").alias("kind"))
    each = each.withColumn("canon", _canonical(F.col("kind"), F.col("entity")))
    known = lookup(surrogates(each, key))
    new = each.join(known, ["kind", "canon"]).select(
        "id", "hash", "at", _formatted(F.col("kind"), F.col("entity"), F.col("surrogate")).alias("new"))
    new = new.groupBy("id", "hash").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("at", "new"))), lambda x: x["new"])
        .alias("new"))
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("hash") == F.col("h"))
    pieces = hinted.dropDuplicates(["id", "hash"]).select(
        F.col("id").alias("i"), F.col("hash").alias("h"), "pieces")
    rebuilt = F.concat_ws("", F.transform(
        "pieces", lambda p, k: F.concat(p, F.coalesce(F.get("new", k), F.lit("")))))
    rebuilt = stage(new.join(pieces, same).select(
        "i", "h", rebuilt.alias("clean"), F.size("new").cast("bigint").alias("n")))
    touched = rows.filter(hint).join(rebuilt, same, "left").select(
        "row", F.coalesce("clean", "text").alias("clean"),
        F.coalesce("n", F.lit(0)).alias("n_entities"))
    rest = rows.filter(~hint).select(
        "row", F.col("text").alias("clean"), F.lit(0).cast("bigint").alias("n_entities"))
    return touched.unionByName(rest)
