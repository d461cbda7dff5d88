"""Personal data replaced by keyed surrogates of the same type, gender, script and format.

A surrogate depends on a secret key and on the entity's canonical form only, so one entity has one
surrogate in the whole corpus, however it is written, and nobody without the key can undo it.
Surrogates are checked against each other and against all entities of the corpus: whoever collides
is drawn again, until distinct entities have distinct surrogates and none is somebody else's.
A format may have too few strings for that (one-letter mailboxes at one domain, surnames of four
syllables, phone numbers of five digits).  So from the fourth draw on a surrogate grows: mailboxes
by letters, surnames by syllables, and short phone numbers become long ones.  The other kinds have
a fixed form of 10^9 strings or more (of which entities may use up half) and do not grow.

Replacement happens where the text lies: it is split at the entities, and the gaps are joined with
the surrogates again.  Only the distinct entities are shuffled.

Defined results: a null text stays null; texts without entities and all other columns stay as they
are; repeated rows are all returned; ids play no part.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crowdtide.llm.columns import free_name, has_column
from crowdtide.session import cut_lineage

KEY = "surrogates-1"
ROUNDS = 30
KEPT = 3        # so many draws have the entity's own length

# Titles by the gender they tell.
MALE_TITLES = ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Signora", "Госпожа", "Κυρία")
# Sixteen given names for each gender and script.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Nils Oscar Paul",
    ("f", "latin"): "Anna Berta Clara Diana Emma Flora Greta Hanna Irene Julia Katja Laura Maria Nora Olga Paula",
    ("m", "cyrillic"): "Антон Борис Вадим Глеб Денис Егор Захар Иван Кирилл Леонид Максим Никита Олег Павел Роман Семён",
    ("f", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Инна Кира Лариса Марина Нина Ольга Полина Рената",
    ("m", "greek"): "Αλέξης Βασίλης Γιώργος Δημήτρης Ευάγγελος Ζήσης Ηλίας Θωμάς Ιάσων Κώστας Λεωνίδας Μάρκος Νίκος Ορέστης Πέτρος Στέφανος",
    ("f", "greek"): "Αγγελική Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ηρώ Θάλεια Ιωάννα Κατερίνα Λυδία Μαρία Νεφέλη Όλγα Πηνελόπη Σοφία",
}
# Sixteen syllables for surnames, sixteen letters for other words.
SYLLABLES = {
    "latin": "ba den for gal hem kin lor man nel por quin ras sel tor ven wal",
    "cyrillic": "бар вен гор дан зал кин лев мир нов пол рад сав тол фед хар цев",
    "greek": "βαρ γιαν δελ ζαν θαλ καλ λαμ μαν νικ παπ ραλ σαμ ταλ φιλ χαρ ψαλ",
}
LETTERS = {"latin": "bcdfghjklmnpqrst", "cyrillic": "бвгджзклмнпрстфх", "greek": "βγδζθκλμνξπρστφχ", "han": "王李张刘陈杨黄赵周吴徐孙马朱胡林"}
RESERVED = r"(?i)(?:^|[.@])(?:example\.(?:com|net|org)|[^.@]+\.(?:example|test|invalid))$"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_NAME = r"\p{Lu}[\p{L}'’-]+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"(?<![\p{L}\p{N}_])(?=[a-zA-Z_]*\d)(?=[\d_]*[a-zA-Z])[a-zA-Z\d_]{20,}+(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![\p{L}\p{N}])",
    "ip": rf"(?<![\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "card": r"(?<![\p{N}.])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7})(?!\d)",
    "ssn": r"(?<![\p{N}-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d-])",
    "name": rf"(?<![\p{{L}}])(?:{'|'.join(sorted(MALE_TITLES + FEMALE_TITLES, key=len, reverse=True))})\.? {_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# what every entity has, found faster than the patterns above
HINT = rf"[0-9@]|[{''.join(sorted({t[0] for t in MALE_TITLES + FEMALE_TITLES}))}]\p{{L}}{{1,8}}\.? \p{{Lu}}"


def entities_of(text: Column) -> Column:
    """All entities of a text in order, as they are written."""
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), 0)).otherwise(none)


def kind_of(surface: Column) -> Column:
    kind = F.lit("secret")
    for name in reversed(("email", "ip", "ssn", "phone", "card", "iban", "name")):
        kind = F.when(surface.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(kind)
    return kind


def _bare(surface: Column) -> Column:
    return F.regexp_replace(surface, r"[^\p{L}\p{N}]", "")


def canonical(kind: Column, surface: Column) -> Column:
    """What an entity is, however it is written: letters lowered, separators and titles dropped."""
    digits = _bare(surface)
    name = F.lower(F.regexp_replace(surface, rf"^\p{{L}}+\.? ", ""))
    return (
        F.when(kind == "email", F.lower(surface)).when(kind == "ip", surface)
        .when(kind == "phone", F.when(F.length(digits) > 10, F.right(digits, F.lit(10))).otherwise(digits))
        .when(kind == "name", F.concat(gender_of(surface), F.lit(":"), name)).otherwise(F.lower(digits))
    )


def gender_of(surface: Column) -> Column:
    return F.when(surface.rlike(rf"^(?:{'|'.join(sorted(FEMALE_TITLES, key=len, reverse=True))})\.? "), F.lit("f")).otherwise(F.lit("m"))


def script_of(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(text.rlike(r"\p{IsGreek}"), F.lit("greek")).when(text.rlike(r"\p{IsHan}"), F.lit("han")).otherwise(F.lit("latin"))


def _stream(digest: Column, alphabet: str) -> Column:
    """64 letters of the alphabet, or decimal digits, from 64 hexadecimal ones."""
    if alphabet == "0123456789":
        return F.translate(digest, "abcdef", "273849")
    return F.translate(digest, "0123456789abcdef", alphabet)


def _poured(surface: Column, digest: Column) -> Column:
    """Every letter and digit replaced by one of its own kind, counted from the right; the rest stays."""
    def one(char, at):
        left = F.length(_bare(F.substring(surface, at + 1, F.length(surface))))
        place = ((left - 1) % 64 + 1).cast("int")
        pick = lambda alphabet: F.substring(_stream(digest, alphabet), place, F.lit(1))
        latin = pick(LETTERS["latin"])
        return (
            F.when(char.rlike(r"^\p{Nd}$"), pick("0123456789")).when(char.rlike(r"^\p{IsHan}$"), pick(LETTERS["han"]))
            .when(char.rlike(r"^\p{IsCyrillic}$"), F.when(char.rlike(r"^\p{Lu}$"), F.upper(pick(LETTERS["cyrillic"]))).otherwise(pick(LETTERS["cyrillic"])))
            .when(char.rlike(r"^\p{IsGreek}$"), F.when(char.rlike(r"^\p{Lu}$"), F.upper(pick(LETTERS["greek"]))).otherwise(pick(LETTERS["greek"])))
            .when(char.rlike(r"^\p{Lu}$"), F.upper(latin)).when(char.rlike(r"^\p{L}$"), latin).otherwise(char)
        )

    return F.array_join(F.transform(F.split(surface, ""), one), "")


def _hex(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("long")


def _hex_poured(surface: Column, digest: Column) -> Column:
    """Hexadecimal for hexadecimal, in the case it has."""
    long = F.substring(F.repeat(digest, F.ceil(F.length(surface) / 64).cast("int")), F.lit(1), F.length(surface))
    return F.when(surface.rlike(r"[A-Z]"), F.upper(long)).otherwise(long)


def _luhn(digits: Column) -> Column:
    """Luhn sum of digits, modulo 10."""
    def weigh(char, at):
        value = char.cast("int")
        twice = value * 2
        return F.when((F.length(digits) - at) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(value)

    return F.aggregate(F.transform(F.split(digits, ""), weigh), F.lit(0), lambda a, b: a + b) % 10


def _card(surface: Column, made: Column, digest: Column) -> Column:
    """The first digit stays (it tells the kind of card), and so does whether the check digit is right."""
    first = F.concat(F.substring(surface, 1, 1), F.substring(made, F.lit(2), F.length(made) - 2))
    check = (10 - _luhn(F.concat(_bare(first), F.lit("0")))) % 10
    wrong = F.when(_luhn(_bare(surface)) == 0, F.lit(0)).otherwise(1 + _hex(digest, 60, 2) % 9)
    return F.concat(first, ((check + wrong) % 10).cast("int").cast("string"))


def _email(surface: Column, digest: Column, grown: Column) -> Column:
    """Same shape, ``grown`` letters or digits longer; the registered domain becomes a reserved one, or stays if it already is."""
    tail = F.regexp_extract(surface, r"[^.@]+\.[^.@]+$", 0)
    head = F.substring(surface, F.lit(1), F.length(surface) - F.length(tail))
    name = F.regexp_extract(tail, r"^[^.]+", 0)
    kept = F.when(surface.rlike(RESERVED), tail).otherwise(F.concat(_poured(name, F.sha2(digest, 256)), F.lit(".example")))
    first = F.regexp_extract(head, r"^[^@]*?([\p{L}\p{Nd}])", 1)
    more = F.repeat(F.when(first == "", F.lit("x")).otherwise(first), grown)
    return F.concat(_poured(F.concat(more, head), digest), kept)


def _ip(digest: Column) -> Column:
    return F.concat_ws(".", *[(_hex(digest, 1 + 6 * k, 6) % 254 + 1).cast("string") for k in range(4)])


def _pick(words: str, digest: Column, at: int) -> Column:
    return F.element_at(F.array(*map(F.lit, words.split())), (_hex(digest, at, 1) + 1).cast("int"))


def _by_script(script: Column, made) -> Column:
    return F.when(script == "cyrillic", made("cyrillic")).when(script == "greek", made("greek")).otherwise(made("latin"))


def _name(surface: Column, digest: Column, grown: Column) -> Column:
    """Title kept; a given name of the same gender and script, and a surname of four syllables and ``grown`` more."""
    def more(words):
        one = lambda k: F.element_at(F.array(*map(F.lit, words.split())), (F.conv(F.substring(digest, k + 13, F.lit(1)), 16, 10).cast("int") + 1))
        return F.when(grown > 0, F.array_join(F.transform(F.sequence(F.lit(1), grown), one), "")).otherwise(F.lit(""))

    title = F.regexp_extract(surface, r"^\p{L}+\.? ", 0)
    rest = F.regexp_replace(surface, r"^\p{L}+\.? ", "")
    script, gender = script_of(rest), gender_of(surface)
    given = _by_script(script, lambda s: F.when(gender == "f", _pick(GIVEN["f", s], digest, 1)).otherwise(_pick(GIVEN["m", s], digest, 1)))
    surname = _by_script(script, lambda s: F.initcap(F.concat(*[_pick(SYLLABLES[s], digest, 10 + k) for k in range(4)], more(SYLLABLES[s]))))
    surname = F.concat(surname, F.when((script == "cyrillic") & (gender == "f"), F.lit("а")).otherwise(F.lit("")))
    made = F.when(rest.contains(" "), F.concat_ws(" ", given, surname)).otherwise(surname)
    return F.concat(title, F.when(F.upper(rest) == rest, F.upper(made)).otherwise(made))


def surrogates(surfaces: Column, attempts: Column, key: str = KEY, kind: Column | None = None) -> Column:
    """For each entity (kind, surface, canon, made): its surrogate, written as the entity is.

    ``attempts``: by surface, the number of an entity's draw.  ``kind``: the kind of all of them, if
    it is known and their form does not tell it.  Each step's lambda variable holds what the step
    before worked out, so nothing is worked out twice.
    """
    kinds = F.transform(surfaces, lambda m: F.struct(m.alias("surface"), (kind_of(m) if kind is None else kind).alias("kind")))
    canons = F.transform(kinds, lambda e: F.struct(e["surface"].alias("surface"), e["kind"].alias("kind"), canonical(e["kind"], e["surface"]).alias("canon")))

    def digest(e):
        return F.sha2(F.concat_ws("\x1f", F.lit(key), e["kind"], e["canon"], e["attempt"].cast("string")), 256)

    def poured(e):
        from_third = F.concat(F.substring(e["surface"], 1, 2), _poured(F.substring(e["surface"], F.lit(3), F.length(e["surface"])), e["digest"]))
        short = (e["kind"] == "phone") & (e["grown"] > 0) & (F.length(_bare(e["surface"])) < 10)
        whole = F.when(short, F.lit("+1 200 300 4000")).otherwise(e["surface"])
        return F.when(e["kind"] == "iban", from_third).when(e["kind"].isin("phone", "card", "ssn", "secret"), _poured(whole, e["digest"]))

    def made(e):
        kind, surface, hashed = e["kind"], e["surface"], e["digest"]
        country = F.length(_bare(surface)) - 10     # a country code stays
        return (
            F.when(kind == "email", _email(surface, hashed, e["grown"])).when(kind == "ip", _ip(hashed)).when(kind == "name", _name(surface, hashed, e["grown"]))
            .when((kind == "phone") & (country > 0), _keep_left(surface, e["poured"], country)).when(kind == "card", _card(surface, e["poured"], hashed))
            .when((kind == "secret") & surface.rlike(r"^\p{XDigit}+$"), _hex_poured(surface, hashed)).otherwise(e["poured"])
        )

    drawn = F.transform(canons, lambda e: e.withField("attempt", F.coalesce(F.try_element_at(attempts, e["surface"]), F.lit(0))))
    hashed = F.transform(drawn, lambda e: e.withField("digest", digest(e)).withField("grown", F.greatest(e["attempt"] - (KEPT - 1), F.lit(0))))
    with_poured = F.transform(hashed, lambda e: e.withField("poured", poured(e)))
    return F.transform(with_poured, lambda e: F.struct(e["kind"].alias("kind"), e["surface"].alias("surface"), e["canon"].alias("canon"), made(e).alias("made")))


def _keep_left(surface: Column, made: Column, digits: Column) -> Column:
    """The first ``digits`` digits from the surface, the rest from what was made (same length)."""
    place = lambda text: F.length(_bare(text))
    cut = F.aggregate(
        F.sequence(F.lit(1), F.length(surface)), F.lit(0),
        lambda best, k: F.when(place(F.substring(surface, F.lit(1), k)) <= digits, k).otherwise(best),
    )
    return F.concat(F.substring(surface, F.lit(1), cut), F.substring(made, cut + 1, F.length(made)))


def _plain(kind: Column, canon: Column) -> Column:
    """A canonical form as it could be written."""
    titled = F.concat(F.when(canon.startswith("f:"), F.lit("Mrs ")).otherwise(F.lit("Mr ")), F.initcap(F.substring(canon, 3, 1 << 20)))
    return F.when(kind == "name", titled).otherwise(canon)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (kind, canon) of the corpus."""
    found = docs.select(F.explode(F.array_distinct(entities_of(F.col(text_col)))).alias("surface"))
    kinds = found.select(kind_of(F.col("surface")).alias("kind"), "surface")
    return kinds.select("kind", canonical(F.col("kind"), F.col("surface")).alias("canon")).distinct()


def assignments(known: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon, attempt and surrogate (canonical) for every entity, free of collisions."""
    def drawn(rows):
        plain = rows.withColumn("plain", _plain(F.col("kind"), F.col("canon")))
        made = surrogates(F.array("plain"), F.create_map("plain", "attempt"), key, F.col("kind"))[0]["made"]
        return cut_lineage(plain.withColumn("made", made).select("kind", "canon", "attempt", canonical(F.col("kind"), F.col("made")).alias("surrogate")))

    known = cut_lineage(known)
    table = drawn(known.withColumn("attempt", F.lit(0)))
    taken = known.select("kind", F.col("canon").alias("surrogate"))
    for attempt in range(1, ROUNDS + 1):
        holders = table.groupBy("kind", "surrogate").agg(F.max("attempt").alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1")
        # of those that drew the same, one that has drawn most often stays
        shared = table.join(holders, ["kind", "surrogate"])
        stays = shared.where("attempt = most").groupBy("kind", "surrogate").agg(F.min("canon").alias("stays"))
        lost = shared.join(stays, ["kind", "surrogate"]).where("canon <> stays").select("kind", "canon")
        lost = cut_lineage(lost.union(table.join(taken, ["kind", "surrogate"], "left_semi").select("kind", "canon")).distinct())
        if lost.isEmpty():
            return table
        # whoever has to draw in a late round draws a grown one, however seldom it has drawn before
        again = table.join(lost.withColumn("next", F.lit(attempt)), ["kind", "canon"], "left")
        table = drawn(again.select("kind", "canon", F.coalesce("next", "attempt").alias("attempt")))
    raise ValueError(f"surrogates still collide after {ROUNDS} rounds: too few strings of a format that cannot grow")


def _redrawn(docs: DataFrame, text_col: str, table: DataFrame, key: str, attempts: str) -> DataFrame | None:
    """By hash of a text (column ``key``), the ``attempts`` of those of its entities that were drawn again."""
    redrawn = cut_lineage(table.where("attempt > 0").select("kind", "canon", "attempt"))
    if redrawn.isEmpty():
        return None
    text = F.col(text_col)
    held = docs.where(text.rlike(HINT)).select(F.xxhash64(text).alias(key), F.explode(F.array_distinct(entities_of(text))).alias("surface"))
    held = held.withColumn("kind", kind_of(F.col("surface"))).withColumn("canon", canonical(F.col("kind"), F.col("surface")))
    few = held.join(redrawn, ["kind", "canon"]).select(key, "surface", "attempt").distinct()
    return cut_lineage(few.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("surface", "attempt"))).alias(attempts)))


def replace(docs: DataFrame, text_col: str = "text", key: str = KEY) -> DataFrame:
    """All rows and columns with entities replaced; adds ``n_replaced``.

    A column of the table with that name stays as it is, and the count is left out.
    """
    text = F.col(text_col)
    hashed, found, tried, done = (free_name(docs, n) for n in ("_key", "_found", "_attempts", "_made"))
    attempts = _redrawn(docs, text_col, assignments(entities(docs, text_col), key), hashed, tried)
    none = F.create_map().cast("map<string,int>")
    rows = docs.withColumn(found, entities_of(text))
    if attempts is None:
        rows = rows.withColumn(tried, none)
    else:
        rows = rows.withColumn(hashed, F.xxhash64(text)).join(attempts, hashed, "left").drop(hashed).withColumn(tried, F.coalesce(tried, none))
    made = F.when(F.size(found) > 0, surrogates(F.col(found), F.col(tried), key))
    # a name told by its title is the same person where it stands without one, as words of its own
    bare = lambda name: F.regexp_replace(name, r"^\p{L}+\.? ", "")
    whole = lambda name: F.concat(F.lit(r"(?<![\p{L}\p{N}])(?<![\p{L}]-)\Q"), name, F.lit(r"\E(?![\p{L}\p{N}]|-\p{L})"))
    people = F.filter(done, lambda e: (e["kind"] == "name") & bare(e["surface"]).contains(" "))
    renamed = lambda gap: F.aggregate(people, gap, lambda said, e: F.when(
        said.contains(bare(e["surface"])), F.regexp_replace(said, whole(bare(e["surface"])), bare(e["made"]))).otherwise(said))
    joined = F.array_join(F.zip_with(F.split(text, ANY, -1), done, lambda gap, e: F.concat(renamed(gap), F.coalesce(e["made"], F.lit("")))), "")
    count = F.coalesce(F.size(found), F.lit(0)).cast("long")
    rows = rows.withColumn(done, made).withColumn(text_col, F.when(count > 0, joined).otherwise(text))
    return (rows if has_column(docs, "n_replaced") else rows.withColumn("n_replaced", count)).drop(found, tried, done)
