"""Personal data: entities get keyed surrogates of the same type, gender, script and format.

Equal entities get equal surrogates in all documents, different ones different
surrogates, and no surrogate is an entity of the corpus.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.llm.common import as_before, documents, large, let, real_id, rest_of_row
from marginalia.session import materialise

# Titles before a name, with the gender they tell (fixed values).
TITLES = {
    "m": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин"),
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mademoiselle", "Señora", "Sra", "госпожа"),
    "n": ("Dr", "Prof", "Professor"),
}
SECRET_WORDS = "token|secret|password|passwd|api[_-]?key|access[_-]?key"
# One run of characters that gives back as many as it must; a repeated group would need a stack as deep as the text.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?=[A-Za-z0-9-])[A-Za-z0-9.-]+(?<=[A-Za-z0-9-]\.[A-Za-z]{2,63})"
SECRET = rf"(?i:{SECRET_WORDS})\s{{0,3}}[:=]\s{{0,3}}[\"'][^\s\"']{{8,}}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ADDRESS = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
# Digits among which cards are looked for, and a card that no digit stands next to.
RUN = r"(?<![0-9])[0-9](?:[ .-]?[0-9]){12,}+"
LONE_CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])"
_TITLE = "|".join(t for group in TITLES.values() for t in group)
_PART = r"\p{Lu}[\p{L}'’-]+"
NAME = rf"(?<!\p{{L}})(?:{_TITLE})\.?[ ]{_PART}(?:[ ]{_PART})?"
BEFORE_CARDS, AFTER_CARDS = f"{EMAIL}|{SECRET}", f"{PHONE}|{ADDRESS}|{NAME}"

# Syllables of invented names by script (fixed values), and the endings that tell a gender.
SYLLABLES = {
    "latin": "ba ce di fo gu la me ni po ra se ti vo za ke lu mo na ri so".split(),
    "cyrillic": "ба ве ги до зу ла ме ни по ра се ти во за ке лу мо на ри со".split(),
}
ENDINGS = {"latin": {"m": "n", "f": "a", "n": "l"}, "cyrillic": {"m": "н", "f": "а", "n": "ль"}}
# Lower and upper letters that stand for Cyrillic ones in secrets.
CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Sum of the digits from the right, those at odd (or even) places doubled."""
    return let(
        F.reverse(digits),
        lambda d: F.aggregate(
            F.transform(
                F.sequence(F.lit(1), F.length(d)),
                lambda i: let(
                    F.substring(d, i, F.lit(1)).cast("int"),
                    lambda x: F.when(i % 2 == doubled, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x),
                ),
            ),
            F.lit(0),
            lambda a, x: a + x,
        ),
    )


def _piece(kind: Column, canon: Column, raw: Column) -> Column:
    return F.struct(kind.alias("kind"), canon.alias("canon"), raw.alias("raw"))


def _gender(title: Column) -> Column:
    out = F.lit("n")
    for gender, titles in TITLES.items():
        out = F.when(title.isin(*titles), gender).otherwise(out)
    return out


def _pieces(m: Column) -> Column:
    """A match as pieces that give it when put together; kind and canon tell what to replace."""
    none = F.lit(None).cast("string")
    secret = F.regexp_extract(m, r"^([^\"']*[\"'])(.*)$", 1)
    script = F.when(m.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    words = F.split(m, " ")
    name = let(
        F.array_join(F.array(F.lit(""), _gender(F.regexp_replace(F.get(words, F.lit(0)), r"\.$", "")), script), ":"),
        lambda tail: F.flatten(
            F.transform(
                words,
                lambda w, i: F.when(i == 0, F.array(_piece(none, none, w)))
                .when(i == F.size(words) - 1, F.array(_piece(none, none, F.lit(" ")), _piece(F.concat(F.lit("surname:n:"), script), F.lower(w), w)))
                .otherwise(F.array(_piece(none, none, F.lit(" ")), _piece(F.concat(F.lit("given"), tail), F.lower(w), w))),
            )
        ),
    )
    digits = _digits(m)
    one = lambda kind, canon: F.array(_piece(F.lit(kind), canon, m))
    return (
        F.when(m.rlike(rf"^(?i:{SECRET_WORDS})\s*[:=]"),
               F.array(_piece(none, none, secret), _piece(F.lit("secret"), F.substr(m, F.length(secret) + 1), F.substr(m, F.length(secret) + 1))))
        .when(m.contains("@"), one("email", F.lower(m)))
        .when(m.rlike(rf"^(?:{_TITLE})[. ]"), name)
        .when(m.rlike(rf"^{CARD}$"), one("card", digits))
        .when(m.rlike(rf"^{ADDRESS}$"), one("address", m))
        .otherwise(one("phone", digits))
    )


def _cards(text: Column) -> Column:
    """All card numbers of a text with a right check digit, the longest first.

    A number among other digits may start or end at any of their groups, but holds
    no start of a phone or an address, unless it is the whole row of digits.
    """
    digit = rf"(?!{PHONE}|{ADDRESS})[0-9]"
    forms = [LONE_CARD, *(rf"(?<![0-9]){digit}(?:[ -]?{digit}){{{n - 1}}}(?![0-9])" for n in range(13, 20))]
    found = F.flatten(
        F.transform(
            F.regexp_extract_all(text, F.lit(RUN), F.lit(0)),
            lambda run: F.flatten(F.array(*[F.regexp_extract_all(run, F.lit(f"(?=({form}))"), F.lit(1)) for form in forms])),
        )
    )
    right = F.filter(F.array_distinct(found), lambda c: _luhn_sum(_digits(c), 0) % 10 == 0)
    by_length = F.reverse(F.array_sort(F.transform(right, lambda c: F.struct(F.length(c).alias("n"), c.alias("card")))))
    return F.transform(by_length, lambda x: x["card"])


def _pattern(text: Column) -> Column:
    """The pattern of all entities of a text; of card-like numbers it has only those that are right."""
    return let(
        _cards(text),
        lambda cards: F.when(
            F.size(cards) > 0,
            F.concat(F.lit(rf"{BEFORE_CARDS}|(?<![0-9])(?:"), F.array_join(cards, "|"), F.lit(rf")(?![0-9])|{AFTER_CARDS}")),
        ).otherwise(f"{BEFORE_CARDS}|{AFTER_CARDS}"),
    )


def _matches(text: Column) -> Column:
    """All matches; texts that cannot hold one are not searched."""
    hints = [text.contains(t) for t in ("Mr", "M", "Sir", "Herr", "Señor", "Sr", "госп", "Frau", "Dr", "Prof")[1:]]
    may = text.rlike(r"[0-9@]") | text.rlike(rf"(?i)(?:{SECRET_WORDS})\s{{0,3}}[:=]") | reduce(lambda a, b: a | b, hints)
    return F.when(may, F.regexp_extract_all(text, _pattern(text), F.lit(0))).otherwise(
        F.array().cast("array<string>")
    )


def _by_char(canon: Column, body) -> Column:
    return F.array_join(
        F.transform(F.split(canon, ""), lambda c, i: body(c, i)), ""
    )


def _surrogate(kind: Column, canon: Column, attempt: int, key: str) -> Column:
    """Keyed surrogate; later attempts give other ones out of ever larger ranges, so that some are free.

    E-mail addresses, names and secrets get longer from the fourth attempt on, phones
    and cards (of which there are many in their own format) from the ninth. Addresses
    leave 192.168 for 10 at the fourth, 10 and 127 for all others at the seventh, and
    version 4 for local ones of version 6 at the eleventh.
    """
    secret_key, entity = F.lit(key), F.concat_ws("\x1f", kind, F.lit(str(attempt)), canon)
    h = F.sha2(F.concat(secret_key, F.sha2(F.concat(secret_key, entity), 256)), 256)
    longer, far_longer = max(0, attempt - 2), max(0, attempt - 7)

    def build(h: Column) -> Column:
        pick = lambda i, n: F.pmod(F.xxhash64(h, i), F.lit(n)).cast("int")
        letter = lambda i: F.char(pick(i, 26) + 97)
        digit = lambda i: pick(i, 10).cast("string")
        hexes = lambda i: F.lower(F.hex(pick(i, 16).cast("bigint")))
        length = F.length(canon)

        email = let(
            F.regexp_extract(canon, r"\.[a-z]+$", 0),
            lambda top: F.concat(
                *[letter(F.lit(-1 - k)) for k in range(4 * longer)],
                _by_char(
                    F.substr(canon, F.lit(1), length - F.length(top)),
                    lambda c, i: F.when(c.rlike("[a-z]"), letter(i)).when(c.rlike("[0-9]"), digit(i)).otherwise(c),
                ),
                top,
            ),
        )
        phone = F.concat(
            _by_char(
                canon,
                lambda c, i: F.when(i < length - 10, c)
                .when((i == length - 10) | (i == length - 7), (pick(i, 8) + 2).cast("string"))
                .otherwise(digit(i)),
            ),
            *[digit(F.lit(-1 - k)) for k in range(far_longer)],
        )
        card = let(
            F.concat(
                F.substr(canon, F.lit(1), F.lit(1)),
                F.array_join(F.transform(F.sequence(F.lit(1), length - 2 + far_longer), lambda i: digit(i)), ""),
            ),
            lambda body: F.concat(body, F.pmod(-_luhn_sum(body, 1), F.lit(10)).cast("string")),
        )
        octets = F.split(canon, r"\.")
        first = F.get(octets, F.lit(0))
        inner = (first.isin("10", "127")) | (canon.startswith("192.168."))
        outer = let(pick(F.lit(0), 223) + 1, lambda a: F.when(a.isin(10, 127, 172, 192), a + 1).otherwise(a))
        narrow = canon.startswith("192.168.") & F.lit(longer == 0)
        octet = lambda i: pick(F.lit(i), 256).cast("string")
        address = F.concat_ws(
            ".",
            F.when(narrow, first).when(inner & F.lit(attempt < 6), F.when(first == "192", "10").otherwise(first)).otherwise(outer.cast("string")),
            F.when(narrow, F.lit("168")).otherwise(octet(1)),
            octet(2),
            octet(3),
        )
        if attempt >= 10:
            address = F.concat(F.lit("fd"), *[F.concat(hexes(F.lit(k)), F.lit(":" if k % 4 == 1 else "")) for k in range(29)], hexes(F.lit(29)))
        cyrillic = lambda i: F.substr(F.lit(CYRILLIC), pick(i, len(CYRILLIC)) + 1, F.lit(1))
        nothing_else = ~canon.rlike(r"[A-Za-z0-9]|[^\x00-\x7F]")
        secret = (
            F.when(canon.rlike("^[0-9a-f]+$"), F.concat(_by_char(canon, lambda c, i: hexes(i)), *[hexes(F.lit(-1 - k)) for k in range(4 * longer)]))
            .when(canon.rlike("^[0-9A-F]+$"), F.upper(F.concat(_by_char(canon, lambda c, i: hexes(i)), *[hexes(F.lit(-1 - k)) for k in range(4 * longer)])))
            .otherwise(
                F.concat(
                    _by_char(
                        canon,
                        lambda c, i: F.when(c.rlike("[a-z]"), letter(i))
                        .when(c.rlike("[A-Z]"), F.upper(letter(i)))
                        .when(c.rlike("[0-9]"), digit(i))
                        .when(c.rlike(r"(?=\p{Lu})\p{IsCyrillic}"), F.upper(cyrillic(i)))
                        .when(c.rlike(r"\p{IsCyrillic}"), cyrillic(i))
                        .when(c.rlike(r"\p{Lu}"), F.upper(letter(i)))
                        .when(c.rlike(r"\p{Nd}"), digit(i))
                        .when(c.rlike(r"[^\x00-\x7F]") | nothing_else, letter(i))  # signs stay only among others
                        .otherwise(c),
                    ),
                    *[letter(F.lit(-1 - k)) for k in range(4 * longer)],
                )
            )
        )

        def name(script: str) -> Column:
            syllables = F.array(*[F.lit(s) for s in SYLLABLES[script]])
            end = F.lit("")
            for gender, e in ENDINGS[script].items():
                end = F.when(F.split_part(kind, F.lit(":"), F.lit(2)) == gender, e).otherwise(end)
            count = 3 + longer
            return F.concat(*[F.get(syllables, pick(F.lit(k), len(SYLLABLES[script]))) for k in range(count)], end)

        return (
            F.when(kind == "email", email)
            .when(kind == "phone", phone)
            .when(kind == "card", card)
            .when(kind == "address", address)
            .when(kind == "secret", secret)
            .when(kind.endswith("cyrillic"), name("cyrillic"))
            .otherwise(name("latin"))
        )

    return let(h, build)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canon, surrogate`` of distinct entities, one to one.

    Every entity gets a keyed surrogate; if that is an entity itself, or others
    have it too, all but the first of them (by canonical form) try again. Rounds
    end when none is left; they follow the collisions, not the corpus, and later
    ones have more to choose from.
    """
    entities = materialise(entities.select("kind", "canon").distinct(), "entities")
    taken, todo = None, entities
    for attempt in count():
        tried = todo.withColumn("surrogate", _surrogate(F.col("kind"), F.col("canon"), attempt, key))
        real = entities.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("is_real"))
        rank = F.row_number().over(Window.partitionBy("kind", "surrogate").orderBy("canon"))
        tried = tried.join(large(real), ["kind", "surrogate"], "left").withColumn("rank", rank)
        if taken is not None:
            old = taken.select("kind", "surrogate", F.lit(True).alias("is_old"))
            tried = tried.join(large(old), ["kind", "surrogate"], "left")
        else:
            tried = tried.withColumn("is_old", F.lit(None).cast("boolean"))
        free = F.col("is_real").isNull() & F.col("is_old").isNull() & (F.col("rank") == 1)
        tried = materialise(tried.select("kind", "canon", "surrogate", free.alias("free")), "tried")
        good = tried.filter("free").select("kind", "canon", "surrogate")
        taken = good if taken is None else taken.unionByName(good)
        todo = tried.filter("NOT free").select("kind", "canon")
        if todo.isEmpty():
            return taken


def _in_format(raw: Column, surrogate: Column, kind: Column) -> Column:
    """The surrogate with the separators and the case of the text it replaces."""
    numbered = let(
        F.split(raw, ""),
        lambda chars: F.array_join(
            F.transform(
                chars,
                lambda c, i: F.when(
                    c.rlike("[0-9]"),
                    F.substr(surrogate, F.length(_digits(F.substr(raw, F.lit(1), i + 1))), F.lit(1)),
                ).otherwise(c),
            ),
            "",
        ),
    )
    cased = (
        F.when((raw == F.upper(raw)) & (raw != F.lower(raw)), F.upper(surrogate))
        .when(kind.rlike("^(given|surname)"), F.concat(F.upper(F.substr(surrogate, F.lit(1), F.lit(1))), F.substr(surrogate, F.lit(2))))
        .otherwise(surrogate)
    )
    # What a late attempt has more than the text goes to the end.
    numbered = F.concat(numbered, F.substr(surrogate, F.length(_digits(raw)) + 1))
    return F.when(kind.isin("phone", "card"), numbered).when(kind.isin("address", "secret"), surrogate).otherwise(cased)


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """The rows of ``docs`` with all their columns, the text as ``pseudonymise`` leaves it."""
    return as_before(_replaced(docs, key), docs)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id, text, n_entities`` of every row, entities replaced by surrogates.

    E-mail and IPv4 addresses, phone numbers, card numbers (13 to 19 digits with a
    right check digit; others stay), quoted values of secrets, and names after a
    title. The same ``key`` gives the same surrogates for the same corpus; keep it
    outside the data. An entity counts once per place it stands in.

    Null and empty texts come back empty. Rows repeated in full get equal texts;
    rows that share an id but not a text get their own. An empty table gives an
    empty table; other columns are not read. An entity in a third of the documents
    is one row of the distinct entities; its mentions are joined by shuffle, which
    splits them, and each document gets its own pieces back.
    """
    return _replaced(docs, key).select(real_id("doc_id").alias("doc_id"), "text", "n_entities")


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    rows = documents(docs, rest_of_row(docs)).withColumn("version", F.xxhash64("text"))
    pieces = materialise(
        rows.select("doc_id", "version", F.posexplode(_matches(F.col("text"))).alias("at", "match"))
        .select("doc_id", "version", "at", F.posexplode(_pieces(F.col("match"))).alias("part", "piece"))
        .select("doc_id", "version", "at", "part", "piece.*")
        .distinct(),
        "pieces",
    )
    found = pieces.filter("kind IS NOT NULL")
    table = materialise(surrogates(found, key), "surrogates")
    shown = (
        found.join(large(table), ["kind", "canon"])
        .withColumn("shown", _in_format(F.col("raw"), F.col("surrogate"), F.col("kind")))
        .select("doc_id", "version", "at", "part", "shown", F.lit(1).alias("one"))
        .unionByName(
            pieces.filter("kind IS NULL").select(
                "doc_id", "version", "at", "part", F.col("raw").alias("shown"), F.lit(0).alias("one")
            )
        )
    )
    # Pieces make a match, matches in order what stands between the other parts of the text.
    in_order = lambda at: F.sort_array(F.collect_list(F.struct(at, "shown")))["shown"]
    placed = (
        shown.repartition("doc_id", "version")
        .groupBy("doc_id", "version", "at")
        .agg(F.array_join(in_order("part"), "").alias("shown"), F.sum("one").alias("one"))
        .groupBy("doc_id", "version")
        .agg(in_order("at").alias("replaced"), F.sum("one").alias("n_entities"))
    )
    text = F.col("text")
    changed = F.array_join(
        F.transform(
            F.split(text, _pattern(text), -1),
            lambda p, i: F.concat(p, F.coalesce(F.get("replaced", i), F.lit(""))),
        ),
        "",
    )
    return rows.join(large(placed), ["doc_id", "version"], "left").withColumns(
        {
            "text": F.when(F.col("replaced").isNull(), text).otherwise(changed),
            "n_entities": F.coalesce("n_entities", F.lit(0)).cast("bigint"),
        }
    )
