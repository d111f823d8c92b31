"""Operator 13: personal data, with DataFrame functions only.

Regular expressions propose spans, arithmetic confirms them (Luhn's sum, remainder 97, parts of an address) and words nearby raise or
lower their score. All happens within a row: no shuffle, no Python. A pattern's matches and the pieces of text between them give the
places of the matches, as running sums of their lengths.

The patterns never go back over a run of characters: each starts where such a run starts (or where the last match ended) and takes
what it can, so a text without blanks costs no more than its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Kinds of the contract, and those that the method adds.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "local_phone")
#: Characters before and after a match in which words count.
BEFORE, AFTER = 40, 24
#: Added kinds need this score; those of the contract stay whatever their score.
THRESHOLD = 0.5
#: What a word for the kind adds, and one against it takes.
FOR, AGAINST = 0.3, 0.3
SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"
#: Numbers whose running sum is taken at a time.
BLOCK = 1000

#: Lengths of international bank account numbers by country (ISO 13616 registry).
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


def iban_pattern() -> str:
    """Country, check digits and as many characters as the country's numbers have, single blanks or hyphens between them."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    some = "|".join(rf"(?:{'|'.join(countries)})[0-9]{{2}}(?:[\x20-]?[A-Z0-9]){{{n - 4}}}" for n, countries in sorted(by_length.items()))
    return rf"(?<![A-Za-z0-9])(?:{some})(?![A-Za-z0-9])"


#: Java patterns. The first four find what the contract's find.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": iban_pattern(),
    "ssn": r"(?<![0-9A-Za-z.+-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "local_phone": r"(?<![0-9A-Za-z+.])(?<!\+[0-9]{1,3}[\x20().-]{0,2})(?<![0-9][\x20()./-]{1,2})\(?[0-9][0-9()\x20./-]{5,18}[0-9](?![0-9A-Za-z])",
}
#: A text without this character has no match.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "ssn": "-"}
SCORES = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.5, "local_phone": 0.3}
#: Words nearby that speak for a kind, in English, German, French and Spanish.
WORDS_FOR = {
    "email": r"e-?mails?|mail|contact|write|reply|kontakt|adresse|courriel|correo|escriba",
    "ip": r"ip|ipv4|address|host|server|login|adresse|dirección|servidor|serveur",
    "card": r"card|credit|visa|mastercard|amex|payment|karte|kreditkarte|carte|tarjeta|zahlung|paiement|pago",
    "phone": r"phone|tel|telephone|mobile|cell|call|fax|whatsapp|telefon|handy|anruf|téléphone|portable|teléfono|móvil|llame",
    "iban": r"iban|account|bank|transfer|konto|überweisung|compte|virement|cuenta|transferencia",
    "ssn": r"ssn|social|security|sozialversicherungsnummer|sécurité|seguro|seguridad",
    "local_phone": r"phone|tel|telephone|mobile|cell|call|fax|whatsapp|telefon|handy|anruf|téléphone|portable|teléfono|móvil|llame",
}
#: Words nearby that speak against any kind: numbers of things.
WORDS_AGAINST = r"version|release|isbn|issn|doi|sku|serial|part|order|invoice|ticket|tracking|sha|md5|token|hash|checksum|build|commit|section|figure|bestellung|rechnung|commande|facture|pedido|factura"
DATE = r"^(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:(?:19|20)[0-9]{2}|[0-9]{2}))\b"


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def n_digits(match: Column, least: int, most: int) -> Column:
    return F.char_length(digits(match)).between(least, most)


def luhn(match: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled and its own digits added, divides by ten."""
    doubled = lambda v: F.when(v > 4, 2 * v - 9).otherwise(2 * v)
    each = F.transform(F.regexp_extract_all(F.reverse(digits(match)), F.lit("[0-9]"), F.lit(0)), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda held, v: held + v) % 10 == 0


def mod_97(match: Column) -> Column:
    """Whether the number, its first four characters at its end and letters as 10 to 35, leaves 1."""
    bare = F.regexp_replace(match, "[^A-Z0-9]", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    put = lambda held, c: F.when(c.between("0", "9"), held * 10 + F.ascii(c) - 48).otherwise(held * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.regexp_extract_all(turned, F.lit("[A-Z0-9]"), F.lit(0)), F.lit(0), put) == 1


def confirmed(kind: str, match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": F.when(n_digits(match, 13, 19), luhn(match)).otherwise(False),
        "phone": n_digits(match, 9, 15),
        "iban": mod_97(match),
        "ssn": F.lit(True),
        "local_phone": n_digits(match, 7, 12) & ~match.rlike(DATE),
    }[kind]


def score(kind: str, before: Column, after: Column) -> Column:
    """The kind's score, raised and lowered once each by words nearby."""
    near = F.concat_ws(" ", before, after)
    word = lambda words: near.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{words})(?![\p{{L}}\p{{N}}])")
    made = F.lit(SCORES[kind]) + F.when(word(WORDS_FOR[kind]), FOR).otherwise(0.0) - F.when(word(WORDS_AGAINST), AGAINST).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), made)), 2)


def scan(numbers: Column) -> Column:
    """0 and the running sums of a short array."""
    return F.aggregate(numbers, F.array(F.lit(0).cast("long")), lambda held, v: F.array_append(held, F.element_at(held, -1) + v))


def running_sums(numbers: Column) -> Column:
    """The running sums of an array of any length: of its blocks, and then of the blocks' own sums."""
    blocks = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(numbers) / F.lit(BLOCK)).cast("int") - 1))
    inner = F.transform(blocks, lambda b: scan(F.slice(numbers, b * BLOCK + 1, BLOCK)))
    held = scan(F.transform(inner, lambda sums: F.element_at(sums, -1)))
    return F.flatten(F.zip_with(inner, F.slice(held, F.lit(1), F.size(inner)), lambda sums, before: F.transform(F.slice(sums, F.lit(2), F.size(sums) - 1), lambda v: v + before)))


def find(docs: DataFrame, kinds: tuple[str, ...] = (*BASE, *ADDED), threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any more): doc_id and spans, (kind, start, end, score) in code points, by kind and start.

    Matches of a kind don't overlap; those of different kinds may. Null and empty texts have no spans. Very long texts are read whole,
    in time that grows with their length. Repeated rows come out each; null doc_ids stay null. An empty table gives none; other
    columns, whatever their names, aren't read. Kinds of the contract are kept if their digits or parts are right, others if their
    score reaches ``threshold`` too.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    piece = lambda g: F.struct(F.char_length(g).alias("n"), F.substring(g, -BEFORE, BEFORE).alias("before"), F.substring(g, 1, AFTER).alias("after"))
    pieces = {k: F.transform(F.split("text", PATTERNS[k], -1), piece) for k in kinds}
    rows = rows.withColumns({f"pieces_{k}": F.when(F.contains("text", F.lit(NEEDS[k])), made) if k in NEEDS else made for k, made in pieces.items()})
    # a second search only where the first found something
    found = {k: F.when(F.size(f"pieces_{k}") > 1, F.regexp_extract_all(F.col("text"), F.lit(PATTERNS[k]), F.lit(0))) for k in kinds}
    rows = rows.withColumns({f"found_{k}": found[k] for k in kinds}).drop("text")
    steps = {k: F.zip_with(F.slice(f"pieces_{k}", F.lit(1), F.size(f"found_{k}")), F.col(f"found_{k}"), lambda g, t: (g["n"] + F.char_length(t)).cast("long")) for k in kinds}
    rows = rows.withColumns({f"steps_{k}": F.when(F.size(f"found_{k}") > 0, steps[k]) for k in kinds})
    rows = rows.withColumns({f"ends_{k}": F.when(F.size(f"steps_{k}") > 0, running_sums(F.col(f"steps_{k}"))) for k in kinds})

    def spans(k: str) -> Column:
        near = lambda i: (F.get(f"pieces_{k}", i)["before"], F.get(f"pieces_{k}", i + 1)["after"])
        place = lambda t, i: ((F.get(f"ends_{k}", i) - F.char_length(t)).alias("start"), F.get(f"ends_{k}", i).alias("end"))
        right = lambda t, i: F.when(confirmed(k, t), F.struct(F.lit(k).alias("kind"), *place(t, i), score(k, *near(i)).alias("score")))
        kept = (lambda s: s.isNotNull()) if k in BASE else (lambda s: s["score"] >= threshold)
        return F.when(F.size(f"found_{k}") > 0, F.filter(F.transform(f"found_{k}", right), kept)).otherwise(F.array().cast(SPAN))

    rows = rows.select("doc_id", *[spans(k).alias(f"spans_{k}") for k in kinds])
    return rows.select("doc_id", F.concat(*[F.col(f"spans_{k}").cast(SPAN) for k in kinds]).alias("spans"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    found = find(common.table(spark, sf_dir, "documents")).withColumn("base", F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, BASE), F.sha2(F.encode(line(F.col("base")), "UTF-8"), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
