"""Surrogates for personal data, in DataFrame operations only.

Detected entities are replaced by keyed surrogates of their type, everywhere the same (coreference) and never shared by two entities
(distinctness), however a mention is written. Types and what a surrogate keeps:

* ``email``: letters for letters and digits for digits in the local part; the domain becomes a name under example.com, .net or .org;
* ``phone``: country code, grouping and length; ``ssn``: grouping and length; ``card``: grouping, length, first digit and check digit;
* ``ip``: four numbers from 1 to 254; ``iban``: country, grouping and length;
* ``given`` and ``family`` names after a form of address, of any number of words: the gender that their mentions agree on, the script (Latin, Cyrillic, Greek), and the
  mention's capitals; initials among them become other letters. Words of such a name are replaced in the same text wherever they stand alone with a capital.

An entity is a type and its canonical form (digits only, or lower case). Candidates come from a SHA-256 of key, type, entity and attempt. A candidate is refused if it is
itself an entity of the corpus, was given before, or is also the candidate of a lesser entity; refused entities try again until
none is left. Entities of a format of which the corpus has (nearly) all values cannot all have one that is none of them: these exchange their values. Only mentions are
shuffled for that, and only texts with mentions for putting the replacements in. ``n_name`` counts names with a form of address.

Defined cases: null texts stay null, empty texts empty. Repeated rows are replaced each for itself and alike. Rows are told apart by a number of
their own, so ``doc_id`` may be null or repeated. An empty table gives an empty table. Columns that are not read are passed on.
Digit runs that are no valid card number, and numbers over 255 in a dotted group, are no entities.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorelake.llm.common import col, fresh, quoted, stored

MALE = "Mr|Mister|Herr|Monsieur|Señor|Sr|Don|г-н|господин|κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Doña|г-жа|госпожа|κυρία"
# A name word ends in a letter, before the mark of possession if it has one; an initial has its full stop.
_WORD = r"\p{Lu}(?:[\p{L}-]|['’](?!s(?!\p{L})))*\p{L}"
_NAME = rf"(?:{_WORD}|\p{{Lu}}\.(?= \p{{Lu}}))"
TITLE = rf"(?:{MALE}|{FEMALE}|Dr|Prof)\.?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
# Alternatives in the order in which they are tried at a place.
_PLACES = "".join((
    r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    rf"|{_OCTET}(?:\.{_OCTET}){{3}}(?![\d]|\.\d)",
    r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    r"|\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    r"|\d(?:[ -]?\d){12,18}(?![\p{N}])",
    r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)",
    r"|\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"|\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    rf"|{TITLE} {_NAME}(?: {_NAME})*"))
PATTERN = rf"(?<![\p{{L}}\p{{N}}._%+@-])(?:{_PLACES})"
# In texts with a form of address every word with a capital is looked up among the text's names.
WITH_WORDS = rf"(?<![\p{{L}}\p{{N}}._%+@-])(?:{_PLACES}|{_WORD}(?!\p{{L}}))"
# Which texts can have a mention at all: cheap tests before the whole patterns.
TITLED = rf"{TITLE} \p{{Lu}}"
HINT = rf"@|\d\d|\d\.\d|{TITLED}"
_VOWELS = {"latin": "a e i o u", "cyrillic": "а е и о у", "greek": "α ε ι ο υ"}
_STARTS = {"latin": "b d f g k l m n r s t v", "cyrillic": "б д ф г к л м н р с т в", "greek": "β δ φ γ κ λ μ ν ρ σ τ ζ"}
# Endings of given names by gender ("m", "f", "x": not said), and of family names.
_ENDINGS = {
    "latin": {"m": "n", "f": "a", "x": "e", "family": "r"}, "cyrillic": {"m": "н", "f": "а", "x": "е", "family": "в"},
    "greek": {"m": "ς", "f": "α", "x": "ε", "family": "ς"},
}


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def luhn_sum(digits: str) -> str:
    """SQL for the Luhn sum of a digit string."""
    return (f"aggregate(transform(reverse(filter(split({digits}, ''), d -> d <> '')), (d, i) -> "
            "if(i % 2 = 0, cast(d as int), (2 * cast(d as int)) div 10 + (2 * cast(d as int)) % 10)), 0L, (a, x) -> a + x)")


def mention_parts(mention: str) -> str:
    """SQL for the (type, entity, gender, script) structs of one mention; names have one for each word."""
    digits = rf"regexp_replace({mention}, '[^0-9]', '')"
    whole = lambda kind, entity: f"array(named_struct('kind', '{kind}', 'entity', {entity}, 'gender', '', 'script', ''))"
    gender = f"case when {mention} rlike {_quote(f'^(?:{MALE})[. ]')} then 'm' when {mention} rlike {_quote(f'^(?:{FEMALE})[. ]')} then 'f' else 'x' end"
    script = f"case when w rlike {_quote(chr(92) + 'p{IsCyrillic}')} then 'cyrillic' when w rlike {_quote(chr(92) + 'p{IsGreek}')} then 'greek' else 'latin' end"
    last = f"i + 2 = size(split({mention}, ' '))"
    names = (f"transform(slice(split({mention}, ' '), 2, size(split({mention}, ' '))), (w, i) -> named_struct('kind', case when w like '%.' then 'initial' when {last} then 'family' else 'given' end, "
             f"'entity', lower(w), 'gender', if({last}, '', {gender}), 'script', {script}))")
    bare = f"transform(array({mention}), w -> named_struct('kind', 'bare', 'entity', lower(w), 'gender', '', 'script', {script}))"
    return f"""case
        when {mention} like '%@%' then {whole('email', f'lower({mention})')}
        when {mention} rlike '^[0-9.]+$' and {mention} like '%.%.%.%' then {whole('ip', mention)}
        when {mention} rlike '^[A-Z][A-Z][0-9]' then {whole('iban', f"regexp_replace({mention}, ' ', '')")}
        when {mention} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' then {whole('ssn', digits)}
        when {mention} rlike '^[0-9 -]+$' and length({digits}) >= 13 then if({luhn_sum(digits)} % 10 = 0, {whole('card', digits)}, {whole('none', mention)})
        when {mention} rlike '^[+(0-9]' then {whole('phone', f"concat(if({mention} like '+%', '+', ''), {digits})")}
        when {mention} like '% %' then {names} else {bare} end"""


_ALPHABETS = {"latin": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "cyrillic": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "greek": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}


def initial(key: str, entity: str = "entity", script: str = "script") -> Column:
    """The surrogate of an initial: another letter of its alphabet, moved on by a keyed step, so different letters stay different. A letter beside the alphabet is drawn."""
    cases = []
    for writing, letters in _ALPHABETS.items():
        n, at = len(letters), f"instr('{letters}', upper(substr({entity}, 1, 1)))"
        step = f"1 + cast(pmod(xxhash64({_quote(key)}, '{writing}'), {n - 1}) as int)"
        moved = f"if({at} > 0, pmod({at} - 1 + {step}, {n}), cast(pmod(xxhash64({_quote(key)}, {entity}), {n}) as int))"
        cases.append(f"when {script} = '{writing}' then concat(substr('{letters}', 1 + {moved}, 1), '.')")
    return F.expr(f"case {' '.join(cases)} end")


def _draw(seed: str, place: str, n: int) -> str:
    return f"cast(pmod(xxhash64({seed}, {place}), {n}) as int)"


def candidate(kind: str = "kind", entity: str = "entity", gender: str = "gender", script: str = "script", seed: str = "seed") -> Column:
    """The surrogate of an entity for a seed string, of the entity's form."""
    chars = lambda text: f"filter(split({text}, ''), c -> c <> '')"
    like = lambda text, first: (
        f"array_join(transform({chars(text)}, (c, i) -> case when i < {first} then c when c between '0' and '9' then cast({_draw(seed, 'i', 10)} as string) "
        f"when c between 'a' and 'z' then substr('abcdefghijklmnopqrstuvwxyz', 1 + {_draw(seed, 'i', 26)}, 1) "
        f"when c between 'A' and 'Z' then substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 1 + {_draw(seed, 'i', 26)}, 1) else c end), '')")
    tail = f"regexp_extract({entity}, '[.]([a-z]+)$', 1)"
    domain = (f"concat(array_join(transform(sequence(1, 8), i -> substr('abcdefghijklmnopqrstuvwxyz', 1 + {_draw(seed, '1000 + i', 26)}, 1)), ''), "
              f"'.example.', if({tail} in ('com', 'net', 'org'), {tail}, 'org'))")
    email = f"concat({like(f'''split({entity}, '@')[0]''', 0)}, '@', {domain})"
    octets = ", ".join(f"cast(1 + {_draw(seed, str(i), 254)} as string)" for i in range(4))
    stem = like(f"substr({entity}, 1, length({entity}) - 1)", 1)
    check = f"(10 - {luhn_sum(f'''concat({stem}, '0')''')} % 10) % 10"
    name = []
    for writing in _VOWELS:
        starts, vowels = (f"split('{_STARTS[writing]}', ' ')", f"split('{_VOWELS[writing]}', ' ')")
        syllables = f"array_join(transform(sequence(1, 3 + attempt div 4), i -> concat({starts}[{_draw(seed, '2 * i', 12)}], {vowels}[{_draw(seed, '2 * i + 1', 5)}])), '')"
        ending = f"case when {kind} = 'family' then '{_ENDINGS[writing]['family']}' " + " ".join(
            f"when {gender} = '{g}' then '{_ENDINGS[writing][g]}'" for g in "mfx") + " end"
        name.append(f"when {script} = '{writing}' then concat({syllables}, {ending})")
    return F.expr(f"""case {kind}
        when 'email' then {email}
        when 'ip' then concat_ws('.', {octets})
        when 'iban' then {like(entity, 2)}
        when 'ssn' then {like(entity, 0)}
        when 'card' then concat({stem}, {check})
        when 'phone' then {like(entity, f"if({entity} like '+%', if(length({entity}) > 11, length({entity}) - 10, 2), 0)")}
        else case {' '.join(name)} end end""")


def format_class(kind: str = "kind", entity: str = "entity") -> Column:
    """What the surrogates of an entity have in common with it: entities of one class draw from one space."""
    keep = f"case {kind} when 'phone' then if({entity} like '+%', if(length({entity}) > 11, length({entity}) - 10, 2), 0) when 'iban' then 2 when 'card' then 1 else 0 end"
    rest = f"regexp_replace(regexp_replace(substr({entity}, 1 + {keep}), '[0-9]', '0'), '[A-Z]', 'A')"
    return F.expr(f"concat({kind}, '|', if({kind} = 'ip', '', concat(substr({entity}, 1, {keep}), {rest})))")


def exchanged(members: DataFrame, key: str, together: int = 10_000) -> DataFrame:
    """Surrogates for whole classes whose space is used up: every entity takes the value of the next one in a keyed order, so that all stay different
    and none keeps its own. Large classes are dealt into parts of about ``together`` entities."""
    spread = F.xxhash64(F.lit(key), "entity")
    sizes = members.groupBy("class").agg(F.count(F.lit(1)).alias("size"))
    dealt = members.join(sizes, "class").withColumn("part", F.pmod(spread, F.greatest(F.floor(F.col("size") / together), F.lit(1))))
    ring = Window.partitionBy("class", "part")
    order = ring.orderBy(F.xxhash64(F.lit(key), F.lit("order"), "entity"), "entity")
    following = F.coalesce(F.lead("entity").over(order), F.first("entity").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return dealt.select("kind", "entity", "gender", "script", following.alias("surrogate"))


def assigned(entities: DataFrame, key: str, most_attempts: int = 64, patience: int = 8) -> DataFrame:
    """(kind, entity, gender, script, surrogate) for distinct stored entities, checked for collisions; stored.

    Where, after ``patience`` attempts, one of them settles less than a tenth of what is pending, the classes of the rest hold (nearly) as many entities as there are values of
    their format, and values that are no entity cannot be found for all: these classes exchange their own values, see :func:`exchanged`.
    """
    pending, done, waiting = entities.withColumn("attempt", F.lit(0)), None, None
    real = entities.select(F.col("kind").alias("k2"), F.col("entity").alias("taken"))
    names = ["kind", "entity", "gender", "script"]
    for attempt in range(most_attempts):
        seeded = pending.withColumn("seed", F.sha2(F.concat_ws("|", F.lit(key), "kind", "entity", "gender", "script", "attempt"), 256))
        tried = stored(seeded.withColumn("surrogate", candidate()).drop("seed"), "surrogate-candidates")
        taken = real if done is None else real.union(done.select("kind", "surrogate"))
        free = tried.join(taken, (F.col("kind") == F.col("k2")) & (F.col("surrogate") == F.col("taken")), "left_anti")
        least = free.groupBy("kind", "surrogate").agg(F.min(F.struct("entity", "gender", "script")).alias("first"))
        won = least.select("kind", "first.entity", "first.gender", "first.script", "surrogate")
        done = stored(won if done is None else done.unionByName(won), "surrogates")
        pending = stored(tried.join(done, names, "left_anti").drop("surrogate").withColumn("attempt", F.col("attempt") + 1), "surrogates-pending")
        before, waiting = waiting, pending.count()
        if not waiting:
            return done
        if attempt >= patience and before is not None and waiting > 0.9 * before:
            classed = entities.withColumn("class", format_class())
            full = pending.select(format_class().alias("class")).distinct()
            sizes = stored(classed.join(full, "class", "left_semi").groupBy("class").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("class"), "full-classes")
            swapped = exchanged(stored(classed.join(sizes, "class", "left_semi"), "full-class-members"), key)
            done = stored(done.withColumn("class", format_class()).join(sizes, "class", "left_anti").drop("class").unionByName(swapped), "surrogates")
            pending = stored(pending.join(done, names, "left_anti"), "surrogates-pending")
            waiting = None
            if pending.isEmpty():
                return done
    raise ValueError(f"no distinct surrogates after {most_attempts} attempts")


def rendered(mention: str, surrogates: str) -> Column:
    """A mention rewritten with the surrogates of its parts (structs of nth, kind, surrogate), in the mention's own format; as it is where they have none."""
    first = f"{surrogates}[0].surrogate"
    step = ("if(c rlike '[0-9A-Z]', named_struct('at', acc.at + 1, 'out', concat(acc.out, substr(plain, acc.at, 1))), "
            "named_struct('at', acc.at, 'out', concat(acc.out, c)))")
    digits = f"""element_at(transform(array(replace({first}, '+', '')), plain -> aggregate(filter(split({mention}, ''), c -> c <> ''),
        named_struct('at', 1, 'out', ''), (acc, c) -> {step}, acc -> acc.out)), 1)"""
    # The last words of the mention are the name's; what stands before them is the form of address.
    word = f"split({mention}, ' ')[i + size(split({mention}, ' ')) - size({surrogates})]"
    names = f"""concat(if({mention} like '% %', regexp_extract({mention}, '^[^ ]+ ', 0), ''), array_join(transform({surrogates}, (own, i) ->
        if({word} = upper({word}), upper(own.surrogate), initcap(own.surrogate))), ' '))"""
    return F.expr(f"""case when {surrogates}[0].surrogate is null then {mention} when {surrogates}[0].kind = 'email' then if({mention} = upper({mention}), upper({first}), {first})
        when {surrogates}[0].kind = 'ip' then {first} when {surrogates}[0].kind in ('given', 'family', 'initial') then {names} else {digits} end""")


NAMES = "in ('given', 'family', 'initial')"
COUNTED = ("email", "phone", "ip", "card", "ssn", "iban", "name")


def surrogated(docs: DataFrame, key: str, text: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` rewritten and, if asked for, ``n_<type>`` columns (which must not be there yet)."""
    work = [fresh(docs, n) for n in ("row_no", "gaps", "mentions", "parts", "fixed")]
    no, gaps, mentions, parts, fixed = work
    own = col(text).cast("string")
    titled = own.rlike(TITLED)
    all_of = lambda pattern: F.regexp_extract_all(own, F.lit(pattern), F.lit(0))
    rows = docs.withColumn(no, F.monotonically_increasing_id()).withColumn(
        mentions, F.when(titled, all_of(WITH_WORDS)).when(own.rlike(HINT), all_of(PATTERN)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn(gaps, F.when(F.size(mentions) > 0, F.when(titled, F.split(own, WITH_WORDS, -1)).otherwise(F.split(own, PATTERN, -1))))
    rows = stored(rows.withColumn(parts, F.expr(f"transform({quoted(mentions)}, m -> {mention_parts('m')})")), "pii-rows")
    each = rows.where(F.size(mentions) > 0).select(
        F.col(no).alias("row_no"), F.posexplode(F.arrays_zip(F.col(mentions).alias("mention"), F.col(parts).alias("parts"))).alias("at", "m"))
    words = each.select("row_no", "at", F.col("m.mention").alias("mention"), F.posexplode("m.parts").alias("nth", "p")).select("row_no", "at", "mention", "nth", "p.*")
    # A bare word is a mention if a name of the same row has it.
    known = words.where("kind in ('given', 'family')").groupBy("row_no", "entity").agg(F.min("kind").alias("known"))
    bare = words.where("kind = 'bare'").join(known, ["row_no", "entity"], "left").withColumn("kind", F.coalesce("known", F.lit("none"))).drop("known")
    words = stored(words.where("kind <> 'bare'").unionByName(bare), "pii-words")
    # One entity, one surrogate: the gender is the one its mentions agree on.
    says = lambda g: F.max(F.col("gender") == g)
    entities = words.where("kind not in ('none', 'initial')").groupBy("kind", "entity", "script").agg(says("m").alias("m"), says("f").alias("f"))
    gender = F.when(F.col("kind") != "given", "").when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("x")
    given = assigned(stored(entities.select("kind", "entity", gender.alias("gender"), "script"), "pii-entities"), key).drop("gender")
    found = words.join(given, ["kind", "entity", "script"], "left").withColumn("surrogate", F.when(F.col("kind") == "initial", initial(key)).otherwise(F.col("surrogate")))
    per_mention = found.groupBy("row_no", "at", "mention").agg(F.sort_array(F.collect_list(F.struct("nth", "kind", "surrogate"))).alias("s"))
    # Every mention of a row is in the list, in order, so a place in it is found without a search.
    per_row = per_mention.select("row_no", "at", rendered("mention", "s").alias("new")).groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias(fixed))
    joined = rows.where(F.size(mentions) > 0).join(per_row.withColumnRenamed("row_no", "_fixed_row"), F.col(no) == F.col("_fixed_row"), "left").drop("_fixed_row")
    put = F.expr(f"""array_join(flatten(transform({quoted(gaps)}, (g, i) -> if(i < size({quoted(fixed)}), array(g, {quoted(fixed)}[i].new), array(g)))), '')""")
    full = joined.withColumn(text, put).drop(fixed).unionByName(rows.where(~(F.size(mentions) > 0) | F.col(mentions).isNull()))
    out = [F.col(quoted(c)) for c in docs.columns]
    if counts:
        count = lambda k: F.expr(
            f"cast(coalesce(size(filter({quoted(parts)}, p -> p[0].kind {NAMES if k == 'name' else f"= '{k}'"})), 0) as bigint)")
        out += [count(k).alias(f"n_{k}") for k in COUNTED]
    return full.select(*out)


def surrogate_query(docs: DataFrame, key: str = "corpus-key") -> DataFrame:
    return surrogated(docs.select("doc_id", "text"), key)
