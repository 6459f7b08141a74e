"""Surrogates for personal data: keyed, of the same type and format, distinct, the same everywhere."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import stored, whole

# Titles that tell a gender, and given and family names to choose from, by gender and script.
MALE_TITLES = "Mr|Herr|Monsieur|Señor|Sr|г-н"
FEMALE_TITLES = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа"
OPEN_TITLES = "Dr|Prof"
NAMES = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Gabriel Hugo Ivan Jonas Karim Louis Martin Nico Oscar Paul".split(),
    ("f", "latin"): "Alice Bella Clara Diana Emma Flora Greta Hanna Irene Julia Karla Laura Maria Nora Olga Paula".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Денис Егор Игорь Кирилл Максим Никита Олег Павел Роман".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Ксения Мария Нина Ольга Полина Софья".split(),
    ("s", "latin"): "Abbot Baker Carver Dalton Easton Fisher Garner Harper Ingram Jarvis Keller Lambert Mercer Norton Osborn Porter".split(),
    ("s", "cyrillic"): "Белый Ветер Гром Дуб Ёлкин Жук Зимин Ильин Котов Лисин Мороз Носов".split(),
}
# One title or several, as in "Prof. Dr. "; what follows is a family name or a given and a family name.
TITLED = rf"(?:(?:{MALE_TITLES}|{FEMALE_TITLES}|{OPEN_TITLES})\.? )+"
# Labels of secrets in any case, what may follow as in secret_key or token2, and how keys begin.
LABELS = "(?i:password|passwd|secret|token|api[_ -]?key)"
LABEL_END = r"(?i:[_.-][A-Z0-9_.-]{1,30}|[0-9]{1,3}|s|key|value)?"
PREFIXES = "ghp_|gho_|sk_live_|sk-"
PATTERNS = {
    "email": r"(?<![\p{L}\p{M}0-9._%+-])[\p{L}\p{M}0-9._%+-]++@[\p{L}\p{M}0-9-]+(?:\.[\p{L}\p{M}0-9-]+)*\.\p{L}{2,}",
    # The value of an assignment, then whether a label stands before it.
    "secret": rf"(?<=[=:>][ ]{{0,2}}[\"']?)(?=[A-Za-z0-9+/_-]{{8}})(?<={LABELS}{LABEL_END}[\"']?\]?[ ]{{0,2}}[=:]{{1,2}}>?[ ]{{0,2}}[\"']?)[A-Za-z0-9+/_-]{{8,}}"
    r"|(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])"
    rf"|(?<![A-Za-z0-9])(?:{PREFIXES})[A-Za-z0-9]{{16,}}",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?![A-Za-z0-9])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9])|(?<![0-9])3[47][0-9]{13}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
    r"|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9])",
    "name": rf"(?<!\p{{L}}){TITLED}\p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# What every match contains: texts without it are not searched.
HINT = rf"[0-9@]|{LABELS}|AKIA|ASIA|{PREFIXES}|{TITLED}\p{{Lu}}"
DIGIT_TYPES = ("card", "ssn", "phone")
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def kind_of(entity: Column) -> Column:
    """The type of a match; a secret is what fits nothing else."""
    kind = F.lit("secret")
    for name in ("name", "phone", "ssn", "card", "iban", "ip", "email"):
        kind = F.when(entity.rlike(f"^(?:{PATTERNS[name]})$"), name).otherwise(kind)
    return kind


def canonical(kind: Column, entity: Column) -> Column:
    """What mentions of one entity share: digits or lower case. Names are keyed by their parts instead."""
    digits = F.regexp_replace(entity, "[^0-9]", "")
    return (
        F.when(kind.isin(*DIGIT_TYPES), digits)
        .when(kind == "email", F.lower(entity))
        .when(kind == "iban", F.translate(entity, " ", ""))
        .otherwise(entity)
    )


def _stream(key: str, attempt: Column, *parts: Column) -> Column:
    """Hexadecimal digits that depend on a secret key, enough for any entity of 192 characters."""
    seed = F.concat_ws("\x00", F.lit(key), attempt.cast("string"), *parts)
    return F.concat(*(F.sha2(F.concat(seed, F.lit(f"\x00{n}")), 256) for n in range(3)))


def _disguised(value: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """Digits for digits and letters for letters, by position; past the stream it starts again."""
    last = 6 if hexadecimal else 26
    at = lambda i: F.conv(F.substring(stream, F.pmod(i * 2, F.lit(190)) + 1, F.lit(2)), 16, 10).cast("int")
    letter = lambda i, letters: F.substring(F.lit(letters), F.pmod(at(i), F.lit(last)) + 1, F.lit(1))
    return F.array_join(
        F.transform(
            F.split(value, ""),
            lambda c, i: F.when(c.rlike("[0-9]"), F.pmod(at(i), F.lit(10)).cast("string"))
            .when(c.rlike("[a-z]"), letter(i, LETTERS))
            .when(c.rlike("[A-Z]"), letter(i, LETTERS.upper()))
            .when(c.rlike(r"[\p{L}\p{M}]"), letter(i, LETTERS))
            .otherwise(c),
        ),
        "",
    )


def luhn_sum(digits: Column) -> Column:
    """The check sum of a card number, the last digit counted once."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
            F.when(c.cast("int") * 2 > 9, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def proposed(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical form at an attempt."""
    stream = _stream(key, attempt, kind, canon)
    number = lambda n: F.conv(F.substring(stream, 8 * n + 1, 7), 16, 10).cast("bigint")
    free = _disguised(canon, stream)
    # Cards keep the issuer's digit and whether the check sum holds.
    body = F.concat(F.substring(canon, 1, 1), F.substring(free, F.lit(2), F.length(canon) - 2))
    check = F.pmod(luhn_sum(canon) - luhn_sum(F.concat(body, F.lit("0"))), F.lit(10))
    card = F.concat(body, check.cast("string"))
    # Phone numbers keep the first digit, a country code in most.
    phone = F.concat(F.substring(canon, 1, 1), F.substring(free, F.lit(2), F.length(canon)))
    # Addresses from the range that is never given out.
    ip = F.concat_ws(
        ".", 240 + F.pmod(number(0), F.lit(16)), *(F.pmod(number(k), F.lit(256)) for k in (1, 2)), 1 + F.pmod(number(3), F.lit(254))
    )
    domain = F.regexp_extract(canon, "@(.*)$", 1)
    label = _disguised(F.regexp_extract(domain, "^[^.]+", 0), _stream(key, F.lit(0), F.lit("domain"), domain))
    email = F.concat(
        _disguised(F.regexp_extract(canon, "^[^@]+", 0), stream), F.lit("@"), label, F.lit(".example.org")
    )
    secret = F.when(canon.rlike("^[0-9a-f]+$"), _disguised(canon, stream, hexadecimal=True)).otherwise(free)
    pick = lambda which, n: F.element_at(F.array(*(F.lit(x) for x in which)), (F.pmod(number(n), F.lit(len(which))) + 1).cast("int"))
    # Part of a name: m, f or u (unknown) and a given name, or another mark and a family name.
    mark = F.regexp_extract(canon, r"^(\S+) ", 1)
    male = mark == "m"
    unknown = (mark == "u") & (F.pmod(number(5), F.lit(2)) == 0)
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    given = F.when(cyrillic, F.when(male | unknown, pick(NAMES["m", "cyrillic"], 0)).otherwise(pick(NAMES["f", "cyrillic"], 0))).otherwise(
        F.when(male | unknown, pick(NAMES["m", "latin"], 0)).otherwise(pick(NAMES["f", "latin"], 0))
    )
    family = F.when(cyrillic, pick(NAMES["s", "cyrillic"], 1)).otherwise(pick(NAMES["s", "latin"], 1))
    # After a few attempts a longer name makes room.
    longer = F.when(attempt > 3, F.substring(F.translate(stream, "0123456789", LETTERS[6:16]), F.lit(1), attempt)).otherwise(F.lit(""))
    name = F.concat(F.when(mark.isin("m", "f", "u"), given).otherwise(family), longer)
    iban = F.concat(F.substring(canon, 1, 2), F.substring(free, F.lit(3), F.length(canon)))
    return (
        F.when(kind == "card", card).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "email", email)
        .when(kind == "name", name).when(kind == "iban", iban).when(kind == "ssn", free).otherwise(secret)
    )


def assigned(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canon, surrogate`` for distinct ``kind, canon``; no surrogate is shared or is an entity.

    Every entity proposes one; where several propose the same, the least keeps it, unless an entity
    or an earlier surrogate is the same; the others propose again.
    """
    entities = stored(entities.distinct(), "entities")
    word = F.when(F.col("kind") == "name", F.regexp_extract("canon", r"(\S+)$", 1)).otherwise(F.col("canon"))
    real = entities.select("kind", word.alias("surrogate")).distinct()
    waiting = entities.withColumn("attempt", F.lit(0))
    done: DataFrame | None = None
    while True:
        offers = stored(
            waiting.withColumn("surrogate", proposed(F.col("kind"), F.col("canon"), F.col("attempt"), key)), "offers"
        )
        taken = real if done is None else real.union(done.select("kind", "surrogate"))
        free = offers.join(taken, ["kind", "surrogate"], "left_anti")
        first = free.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        kept = first.select("kind", "canon", "surrogate")
        done = stored(kept if done is None else done.union(kept), "surrogates")
        waiting = stored(
            offers.join(done, ["kind", "canon"], "left_anti").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")),
            "waiting",
        )
        if not waiting.limit(1).count():
            return done


def formatted(kind: Column, entity: Column, surrogate: Column) -> Column:
    """A surrogate written like the mention it stands for."""
    before = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i), "[^0-9]", ""))
    digits = F.array_join(
        F.transform(
            F.split(entity, ""),
            lambda c, i: F.when(c.rlike("[0-9]"), F.substring(surrogate, before(i) + 1, F.lit(1))).otherwise(c),
        ),
        "",
    )
    spaced = F.when(entity.contains(" "), F.rtrim(F.regexp_replace(surrogate, "(.{4})", "$1 "))).otherwise(surrogate)
    upper = F.when((entity == F.upper(entity)) & entity.rlike("[A-Z]"), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin(*DIGIT_TYPES), digits).when(kind == "iban", spaced).when(kind == "email", upper).otherwise(surrogate)


def untitled(mention: Column) -> Column:
    return F.regexp_replace(mention, f"^{TITLED}", "")


def last_word(name: Column) -> Column:
    return F.regexp_extract(name, r"(\S+)$", 1)


def bare_pattern(names: Column) -> Column:
    """Finds the names of a text, and their parts, without a title; no part of an e-mail address."""
    full = F.filter(names, lambda n: n.contains(" "))
    parts = F.concat(full, F.transform(names, last_word), F.transform(full, lambda n: F.substring_index(n, " ", 1)))
    return F.concat(
        F.lit(r"(?<!\p{L})(?=\p{Lu})(?:"),
        F.array_join(F.array_distinct(parts), "|"),
        F.lit(r")(?![\p{L}0-9]|[\p{L}0-9._%+-]*@)"),
    )


def with_names(mentions: DataFrame) -> DataFrame:
    """``given`` and ``family`` of every name, and whether the mention writes each.

    ``_names`` has the names found with a title in the same text. A bare word is a family name if one
    of them ends in it, else the given name of the first that begins with it.
    """
    titled = F.col("entity").rlike(f"^{TITLED}")
    name = untitled(F.col("entity"))
    ends = F.exists("_names", lambda n: last_word(n) == name)
    begun = F.get(F.filter("_names", lambda n: n.startswith(F.concat(name, F.lit(" ")))), F.lit(0))
    alone = ~titled & ~name.contains(" ") & ~ends
    whole_name = F.when(alone, begun).otherwise(name)
    is_name = F.col("kind") == "name"
    return mentions.withColumns(
        {
            "title": F.when(is_name, F.regexp_extract("entity", f"^{TITLED}", 0)),
            "given": F.when(is_name & whole_name.contains(" "), F.substring_index(whole_name, " ", 1)),
            "family": F.when(is_name, last_word(whole_name)),
            "given_alone": F.coalesce(is_name & alone, F.lit(False)),
        }
    )


def parts_of(mentions: DataFrame) -> DataFrame:
    """``_row, pos, part, kind, canon, entity, before, bare``: one row per mention, two for a full name.

    The gender of a full name is that of all its titles in the corpus; if they disagree, that of the
    mention's own title, and female for a mention that tells none.
    """
    said = lambda titles: F.col("title").rlike(rf"(?:^| )(?:{titles})\.? ")
    male, female = said(MALE_TITLES), said(FEMALE_TITLES)
    columns = ["_row", "pos", "part", "kind", "canon", "entity", "before", "bare"]
    others = mentions.filter("kind <> 'name'").select(
        "_row", "pos", F.lit(0).alias("part"), "kind", canonical(F.col("kind"), F.col("entity")).alias("canon"), "entity", F.lit("").alias("before"), "bare"
    )
    names = mentions.filter("kind = 'name'")
    families = names.filter("NOT given_alone").select(
        "_row", "pos", F.when(F.col("given").isNull(), 0).otherwise(1).alias("part"), "kind", F.concat(F.lit("s "), "family").alias("canon"),
        "entity", F.when(F.col("given").isNull(), F.col("title")).otherwise(F.lit(" ")).alias("before"), "bare",
    )
    full = names.filter("given IS NOT NULL")
    sexes = full.groupBy("given", "family").agg(F.max(male).alias("_m"), F.max(female).alias("_f"))
    own = F.when(male & ~female, "m").otherwise("f")
    sex = F.when(F.col("_m") & F.col("_f"), own).when(F.col("_m"), "m").when(F.col("_f"), "f").otherwise("u")
    givens = full.join(sexes, ["given", "family"]).select(
        "_row", "pos", F.lit(0).alias("part"), "kind", F.concat(sex, F.lit(" "), "given").alias("canon"), "entity", F.col("title").alias("before"), "bare"
    )
    return others.union(families).union(givens).select(columns)


def replace_personal_data(docs: DataFrame, key: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Replace personal data in every text of ``docs``: adds ``entities`` and changes the text column.

    ``entities`` has ``(kind, surrogate)`` of each mention in order. Found are e-mail and IP addresses,
    phone, card, social security and bank account numbers, secrets after their label, names after
    a title, and the same names or their parts anywhere else in the text. The surrogate depends on ``key`` and the entity only: all mentions in the corpus get the
    same, written in the mention's own format; no two entities of a kind share one, and none is an
    entity found in the corpus. Names keep title, gender and script, cards their check sum.
    Given and family names have surrogates of their own, so all forms of a name agree.

    Null texts stay null and have no entities. Rows are otherwise independent: null ids, repeated
    rows, empty tables and other columns pass. A column named ``entities`` is replaced; names with an
    underscore are reserved. Texts move once, to meet the surrogates of their mentions.
    """
    rows = docs.drop("entities").withColumn("_row", F.xxhash64(F.col(id_column).cast("string"), F.col(text)))
    found = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)))
    titled = F.filter("_first", lambda m: m.rlike(f"^(?:{PATTERNS['name']})$"))
    searched = rows.select("_row", F.col(text).alias("_text"), found.alias("_first"))
    searched = searched.withColumn("_names", F.array_distinct(F.transform(titled, untitled)))
    searched = searched.withColumn("bare", F.when(F.size("_names") > 0, bare_pattern(F.col("_names"))))
    both = F.regexp_extract_all("_text", F.concat(F.lit(f"{ANY}|"), "bare"), F.lit(0))
    every = F.when(F.col("bare").isNull(), F.col("_first")).otherwise(both)
    mentions = searched.select("_row", "bare", "_names", F.posexplode(every).alias("pos", "entity"))
    is_bare = F.col("bare").isNotNull() & F.rlike("entity", F.concat(F.lit("^(?:"), "bare", F.lit(")$")))
    mentions = mentions.withColumn("kind", F.when(is_bare, "name").otherwise(kind_of(F.col("entity"))))
    # A text's pattern goes with its first mention only.
    mentions = with_names(mentions).withColumn("bare", F.when(F.col("pos") == 0, F.col("bare"))).drop("_names")
    parts = parts_of(stored(mentions, "mentions").dropDuplicates(["_row", "pos"]))
    surrogates = assigned(parts.select("kind", "canon"), key)
    met = parts.join(surrogates, ["kind", "canon"])
    written = F.concat("before", formatted(F.col("kind"), F.col("entity"), F.col("surrogate")))
    by_row = met.select("_row", "bare", F.struct("pos", "part", "kind", written.alias("surrogate")).alias("m"))
    by_row = by_row.groupBy("_row").agg(F.array_sort(F.collect_list("m")).alias("_parts"), F.max("bare").alias("_bare"))
    following = lambda m, i: F.when(F.get("_parts", i + 1)["pos"] == m["pos"], F.get("_parts", i + 1)["surrogate"])
    joined_parts = F.transform(
        "_parts",
        lambda m, i: F.struct(m["part"].alias("part"), m["kind"].alias("kind"), F.concat(m["surrogate"], F.coalesce(following(m, i), F.lit(""))).alias("surrogate")),
    )
    by_row = by_row.select("_row", "_bare", F.filter(joined_parts, lambda m: m["part"] == 0).alias("_found"))
    joined = rows.join(by_row, "_row", "left")
    pieces = F.when(F.col("_bare").isNull(), F.split(F.col(text), ANY)).otherwise(F.split(F.col(text), F.concat(F.lit(f"{ANY}|"), "_bare")))
    ends = F.concat(F.transform("_found", lambda m: m["surrogate"]), F.array(F.lit("")))
    changed = F.array_join(F.flatten(F.transform(F.arrays_zip(pieces.alias("p"), ends.alias("e")), lambda x: F.array(x["p"], x["e"]))), "")
    none = F.array().cast("array<struct<kind:string,surrogate:string>>")
    listed = F.transform("_found", lambda m: F.struct(m["kind"].alias("kind"), m["surrogate"].alias("surrogate")))
    return joined.withColumns(
        {
            "entities": F.coalesce(listed, none),
            text: F.when(F.col("_found").isNotNull(), changed).otherwise(F.col(text)),
        }
    ).drop("_row", "_found", "_bare")
