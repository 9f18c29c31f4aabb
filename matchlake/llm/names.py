"""Variant spellings of one name, of a person or an organisation.

Method: every canonical rewriting of each name is generated (token order, initials and abbreviations, nicknames, legal
forms, dropped middle and second surnames, letter groups that sound alike, one slip of the keyboard), the forms are
exploded and equi-joined, and what two names share is scored by the rarity of the rewritings: a form counts for its owner
with log(names / names that can be rewritten to it), and for each of them when several persons own it. A name is linked to
the owner with the highest score in a compatible country, if that is most of all it could be given.

All owners of a form are scored, but no pairs are made for a name of which sums over its forms show that nobody can own
enough of it. Each member of a form that joins is joined to one representative, and the links are closed by propagating the
smallest label.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchlake.session import cut_lineage, spread, written

# Three-letter codes used in sport where they differ from those of the standard.
SPORT_CODES = {
    "ALG": "DZA", "ANG": "AGO", "ANT": "ATG", "ARU": "ABW", "ASA": "ASM", "BAH": "BHS", "BAN": "BGD", "BAR": "BRB", "BER": "BMU", "BHU": "BTN", "BIZ": "BLZ", "BOT": "BWA",
    "BRU": "BRN", "BUL": "BGR", "BUR": "BFA", "CAM": "KHM", "CAY": "CYM", "CGO": "COG", "CHA": "TCD", "CHI": "CHL", "CRC": "CRI", "CRO": "HRV", "DEN": "DNK", "ENG": "GBR",
    "ESA": "SLV", "FIJ": "FJI", "GAM": "GMB", "GBS": "GNB", "GEQ": "GNQ", "GER": "DEU", "GRE": "GRC", "GRN": "GRD", "GUA": "GTM", "GUI": "GIN", "HAI": "HTI", "HON": "HND",
    "INA": "IDN", "IRI": "IRN", "ISV": "VIR", "IVB": "VGB", "KOS": "XKX", "KSA": "SAU", "KUW": "KWT", "LAT": "LVA", "LBA": "LBY", "LES": "LSO", "LIB": "LBN", "MAD": "MDG",
    "MAS": "MYS", "MAW": "MWI", "MGL": "MNG", "MON": "MCO", "MRI": "MUS", "MTN": "MRT", "MYA": "MMR", "NCA": "NIC", "NED": "NLD", "NEP": "NPL", "NGR": "NGA", "NIG": "NER",
    "NIR": "GBR", "OMA": "OMN", "PAR": "PRY", "PHI": "PHL", "PLE": "PSE", "POR": "PRT", "PUR": "PRI", "RSA": "ZAF", "SAM": "WSM", "SCO": "GBR", "SEY": "SYC", "SKN": "KNA",
    "SLO": "SVN", "SOL": "SLB", "SRI": "LKA", "SUD": "SDN", "SUI": "CHE", "TAN": "TZA", "TGA": "TON", "TOG": "TGO", "TPE": "TWN", "TRI": "TTO", "UAE": "ARE", "URU": "URY",
    "VAN": "VUT", "VIE": "VNM", "VIN": "VCT", "WAL": "GBR", "ZAM": "ZMB", "ZIM": "ZWE",
}

# Given names and their usual short forms.
NICKNAMES = {
    "abigail": "abby", "albert": "al bert", "aleksandr": "sasha", "alexander": "alex sandy sasha", "alexandra": "alex sandra sasha", "andrew": "andy drew", "ann": "annie nancy", "anthony": "tony",
    "benjamin": "ben benny", "catherine": "cathy cat kate", "charles": "charlie chuck", "christopher": "chris kit", "daniel": "dan danny", "david": "dave davy", "deborah": "deb debbie", "dmitri": "dima",
    "donald": "don", "dorothy": "dolly dot", "edward": "ed eddie ned ted", "eleanor": "ellie nell", "elizabeth": "beth betty eliza liz lizzie", "eugene": "gene", "frances": "fran", "francis": "frank",
    "francisco": "paco pancho", "frederick": "fred freddy", "gerald": "gerry jerry", "giuseppe": "beppe", "gregory": "greg", "harold": "hal harry", "helen": "nell", "henry": "hank harry", "ignacio": "nacho",
    "isabel": "bella", "ivan": "vanya", "jacob": "jake", "james": "jamie jim jimmy", "jeffrey": "jeff", "jennifer": "jen jenny", "johannes": "hannes hans", "john": "jack johnny", "jonathan": "jon",
    "jose": "pepe", "josef": "sepp", "joseph": "joe joey", "joshua": "josh", "katherine": "kate kathy katie kitty", "kenneth": "ken kenny", "lawrence": "larry", "leonard": "len lenny leo",
    "margaret": "maggie meg peggy", "martha": "patty", "mary": "molly polly", "matthew": "matt", "maximilian": "max", "michael": "mick mickey mike", "mikhail": "misha", "nathaniel": "nat nate",
    "nicholas": "nick nicky", "patricia": "pat patty trish", "patrick": "paddy pat", "peter": "pete", "philip": "phil", "raymond": "ray", "rebecca": "becky", "richard": "dick rich rick ricky",
    "robert": "bert bob bobby rob robbie", "ronald": "ron", "samantha": "sam", "samuel": "sam", "sarah": "sadie sally", "stephen": "steve", "steven": "steve", "susan": "sue suzy", "theodore": "ted theo",
    "thomas": "tom tommy", "timothy": "tim", "victoria": "tori vicky", "vincent": "vince", "vladimir": "volodya vova", "walter": "walt", "william": "bill billy liam will willy", "yevgeny": "zhenya", "zachary": "zach",
}

# Legal forms of organisations, each with the short form that stands for it.
LEGAL_FORMS = {
    "limited": "ltd", "ltd": "ltd", "incorporated": "inc", "inc": "inc", "corporation": "corp", "corp": "corp", "company": "co", "co": "co", "llc": "llc", "llp": "llp", "plc": "plc", "pty": "pty",
    "gmbh": "gmbh", "ag": "ag", "kg": "kg", "sa": "sa", "sarl": "sarl", "spa": "spa", "srl": "srl", "bv": "bv", "nv": "nv", "oy": "oy", "ab": "ab",
}

_NOISE = re.compile(r"[\[(][^\])]*[\])]|\*")
_DIGRAPHS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ø": "o", "å": "a", "æ": "ae", "œ": "oe", "ß": "ss", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i"})
# Letter groups that are written for one another, in the order in which they are replaced.
_DIPHTHONGS = (("ae", "a"), ("oe", "o"), ("ue", "u"))
_SOUNDS = (("tch", "ch"), ("ck", "k"), ("ph", "f"), ("ay", "ei"), ("ey", "ei"), ("w", "v"), ("z", "s"), ("x", "ks"))
_VOWELS = "aeiouy"


@lru_cache(1)
def _country_codes() -> dict[str, str]:
    """Two-letter codes (from the runtime's own table) and codes used in sport, with the standard's three letters."""
    locale = SparkContext._active_spark_context._jvm.java.util.Locale
    return {two: locale("", two).getISO3Country() for two in locale.getISOCountries()} | SPORT_CODES


def country_code(raw: Column) -> Column:
    """Three-letter code of a country in any of the code systems; null for null or blank. What is no code stays as it is."""
    table = F.create_map(*[F.lit(x) for pair in _country_codes().items() for x in pair])
    code = F.upper(F.trim(raw))
    return F.when(code != "", F.coalesce(F.try_element_at(table, code), code))


@lru_cache(100_000)
def fold(token: str) -> str:
    """Lower case without accents; only letters and digits."""
    plain = unicodedata.normalize("NFKD", token.casefold().translate(_DIGRAPHS))
    return "".join(c for c in plain if c.isalnum())


@lru_cache(100_000)
def sound(token: str) -> str:
    """Letters of a folded token with those that are written for one another made equal, doubles made single."""
    for a, b in _DIPHTHONGS:
        token = token.replace(a, b)
    token = re.sub(rf"ow(?![{_VOWELS}])", "au", token)
    for a, b in _SOUNDS:
        token = token.replace(a, b)
    token = re.sub(r"c(?!h)", "k", token)
    return re.sub(r"(.)\1+", r"\1", token)


@lru_cache(100_000)
def nicknames(given: str) -> tuple[str, ...]:
    """Short forms of a folded given name: those of the table, and by syllables: the first bare or with o, y or ie, the
    second with ki, the head dropped."""
    cuts = [m.end() for m in re.finditer(rf"[{_VOWELS}]+", given)]
    usual = set(NICKNAMES.get(given, "").split())
    if len(cuts) < 2:
        return tuple(sorted(usual | {given + "ki"}))
    head, onset = given[: cuts[0]], re.match(rf"[^{_VOWELS}]*", given[cuts[0] :])[0]
    out = usual | {head, head + "o", given[cuts[0] :]}
    for n in range(1, min(3, len(onset)) + 1):  # consonants that stay with the first syllable
        out |= {head + onset[:n], head + onset[:n] + "y", head + onset[:n] + "o", head + onset[:n] + "s", given[cuts[0] + n - 1 :]}
    if onset:
        out |= {head + onset[0] * 2 + "y", head + onset[0] * 2 + "ie"}
    starts = [0, *cuts[:-1]]
    for a, b in zip(starts, cuts):
        out.add(given[a:b] + "ki")
        piece = given[a:b].lstrip("bcdfghjklmnpqrstvwxz")
        lead = given[a : b - len(piece)]
        out |= {lead[k:] + piece + "ki" for k in range(len(lead))}
    return tuple(sorted(n for n in out if len(n) > 1 and n != given))


@lru_cache(100_000)
def syllables(given: str) -> tuple[str, frozenset[str]]:
    """(what a folded name keeps if it is a nickname, what nicknames of it may keep); the former may be empty."""
    cuts = [m.end() for m in re.finditer(rf"[{_VOWELS}]+", given)]
    if len(given) < 3 or not cuts:
        return "", frozenset()
    if given.endswith("ki") and len(cuts) == 2:
        kept = given[:-2] + "+ki"
    elif given.endswith(("o", "y", "ie")) and len(cuts) == 2:
        kept = given[: cuts[0]] + "+o"
    else:
        kept = given + "+" if len(cuts) <= 2 else ""
    keeps = {given[: cuts[0]] + "+o", given[cuts[0] :] + "+"}
    for a, b in zip([0, *cuts[:-1]], cuts):
        onset = re.match(rf"[^{_VOWELS}]*", given[a:b])[0]
        keeps |= {given[a + k : b] + "+ki" for k in range(max(1, len(onset)))}
    return sound(kept), frozenset(map(sound, keeps)) - {sound(kept)}


def organisation(name: str) -> tuple[str, str] | None:
    """(core, legal form) of a name that ends in a legal form: tokens in order of the alphabet; None for any other name.

    Forms of two letters count only in capitals or with dots beside a token in small letters, or after an "&".
    """
    tokens = [t for t in re.split(r"[\s,]+", _NOISE.sub(" ", name)) if t]
    legal = []
    while len(tokens) > 1 and (form := LEGAL_FORMS.get(fold(tokens[-1]))):
        if len(form) == 2 and len(fold(tokens[-1])) == 2 and tokens[-2] != "&" and not ((tokens[-1].isupper() or "." in tokens[-1]) and any(c.islower() for c in tokens[0])):
            break
        legal.append(form)
        tokens.pop()
    core = sorted(x for x in (sound(fold(t)) for t in tokens) if x and x not in ("and", "the"))
    return (" ".join(core), " ".join(sorted(legal))) if legal and core else None


def readings(name: str) -> list[tuple[list[str], list[str], bool | None]]:
    """(given tokens, surname parts, certain) for each way to read a name; tokens keep a final dot.

    certain is None where the order of the tokens is turned though nothing about the name asks for it.
    """
    text = _NOISE.sub(" ", unicodedata.normalize("NFC", name).replace("\xa0", " ").replace("–", "-")).strip(" ,;")
    if "," in text:
        left, right = text.split(",", 1)
        out = [(right.replace(",", " ").split(), re.split(r"[\s-]+", left.strip()), True)]
    else:
        tokens = text.split()
        bare = [t.rstrip(".") for t in tokens]
        short = [len(fold(b)) == 1 or (t.endswith(".") and len(fold(b)) <= 4 and "-" not in t) for t, b in zip(tokens, bare)]
        split = lambda ts: [p for t in ts for p in t.split("-")]
        # Capitals may hold one slip: TRlUSKIUL is still written in capitals.
        upper = [len(fold(b)) > 1 and sum(map(str.isupper, b)) > 1 and sum(map(str.islower, b)) <= len(b) // 5 for b in bare]
        mixed = any(len(fold(b)) > 1 and not u for b, u in zip(bare, upper))
        if len(tokens) < 2:
            out = [([], split(tokens), True)] if tokens else []
        elif short[-1] and not short[0]:
            out = [([tokens[-1]], split(tokens[:-1]), True)]
            if len(tokens) > 2 and not any(upper):  # surname, given, middle initial
                out.append((tokens[1:], split(tokens[:1]), False))
        elif short[0]:
            n = next((i for i, s in enumerate(short) if not s), len(tokens) - 1)
            out = [(tokens[:n], split(tokens[-1:]), True)]
            if len(tokens) - n > 1:
                out.append((tokens[:n], split(tokens[n:]), False))
        elif any(upper) and mixed:
            out = [([t for t, u in zip(tokens, upper) if not u], split([t for t, u in zip(tokens, upper) if u]), True)]
        else:
            out = [(tokens[:-1], split(tokens[-1:]), True)]
            if len(tokens) > 2 and not short[1]:
                out.append((tokens[:1], split(tokens[1:]), False))
            turned = False if text in (text.lower(), text.upper()) else None
            out.append((tokens[1:], split(tokens[:1]), turned))
            if len(tokens) > 2:
                out.append((tokens[-1:], split(tokens[:-1]), turned))
    clean = []
    for given, surname, certain in out:
        parts = [p for p in (fold(s.rstrip(".")) for s in surname) if p]
        parts = [p for p in parts if len(p) > 1] or parts
        names = [(fold(g), g.endswith(".")) for g in given if fold(g)]
        if parts:
            clean.append((names, parts, certain))
    return clean


def _slips(text: str) -> set[str]:
    """The text and all that is left when one of its letters is taken out: meets at one slip on either side."""
    return {text, *(text[:i] + text[i + 1 :] for i in range(len(text)) if text[i] != "|")}


#: What a form is for: "same" joins all names that have it; "own"/"seek" joins a short name to the one owner.
#: Tiers of the latter are tried in order.
EXACT, SLIPPED = 1, 2


def forms(name: str) -> tuple[str, bool, list[tuple[str, str, int]]]:
    """(canonical name, whether the given name is written out, forms as (form, role, tier))."""
    if firm := organisation(name):
        core, legal = firm
        same = {(f"firm:{x}&{legal}", "same", EXACT) for x in (_slips(core) if len(core) > 7 else {core})}
        return f"firm {core} & {legal}", True, sorted(same | {(f"firm:{core}", "own", EXACT)})
    read = readings(name)
    if not read:
        return "", False, []
    bare = sorted(x for x in (sound(fold(t)) for t in _NOISE.sub(" ", name).split()) if x and x not in ("and", "the"))
    found: set[tuple[str, str, int]] = {(f"firm:{' '.join(bare)}", "seek", EXACT)}
    full = False
    for given, parts, certain in read:
        surname = sound(parts[0])
        if not given:
            continue
        first, dotted = given[0]
        if certain is None:
            found.add((f"{surname}|{sound(first)}?", "seek", EXACT))
            continue
        if len(first) == 1 or (dotted and len(first) <= 4):
            tail = first if len(first) == 1 else first[:3]
            found.add((f"{surname}~{tail}", "seek", EXACT))
            if len(parts) > 1 and certain:
                found.add((f"{sound(parts[-1])}~{tail}", "seek", SLIPPED))
            found |= {(f"{x}~{tail}", "seek", SLIPPED) for x in _slips(surname) | _slips(parts[0]) if len(x) > 3}
            continue
        whole = f"{surname}|{sound(first)}"
        full = full or certain
        if certain or len(given) == 1:
            spelled = f"{parts[0]}|{first}"
            found |= {(x, "same", EXACT) for x in (_slips(whole) | _slips(spelled) if len(whole) > 7 else {whole})}
        found.add((whole, "seek", EXACT))
        if not certain:
            found.add((whole + "?", "seek", EXACT))
            continue
        found.add((whole + "?", "own", EXACT))
        for tail in {first[0], first[:3]}:
            found.add((f"{surname}~{tail}", "own", EXACT))
            found |= {(f"{x}~{tail}", "own", SLIPPED) for x in _slips(surname) | _slips(parts[0]) if len(x) > 3}
            if len(parts) > 1:
                found.add((f"{sound(parts[-1])}~{tail}", "own", SLIPPED))
        # A nickname beside a slip in the surname: both sides give the syllable that the nickname keeps.
        slipped = [x for x in _slips(surname) if len(x) > 3]
        kept, keeps = syllables(first)
        found |= {(f"{x}#{k}", "own", SLIPPED) for x in slipped for k in keeps}
        if kept:
            found |= {(f"{x}#{kept}", "seek", SLIPPED) for x in slipped}
        for nick in nicknames(first):
            if (short := f"{surname}|{sound(nick)}") != whole:
                found.add((short, "own", EXACT))
    given, parts, _ = read[0]
    return " ".join([*parts, "|", *[g + "." * d for g, d in given]]), full, sorted(found)


#: Codes of the roles in name_forms.
ROLES = {"same": 0, "own": 1, "seek": 2}


def name_forms(names: DataFrame) -> DataFrame:
    """(name, country, node, full, forms) of the distinct names and countries of ``names``.

    A node is a canonical name in a country, as a 64-bit hash: spellings that differ in nothing but their dress share
    it. forms: structs of form (64-bit hash), role (its code), tier and whether it is a short name's form.
    """

    columns = ["name", "country", "node", "full", "forms"]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, country in zip(batch["name"], batch["country"]):
                canonical, full, found = forms(name)
                if canonical:
                    hashed = [{"form": xxhash.xxh64_intdigest(f) - 2**63, "role": ROLES[r], "tier": t, "short": "~" in f} for f, r, t in found]
                    rows.append((name, country, xxhash.xxh64_intdigest(f"{canonical} @{country or ''}") - 2**63, full, hashed))
                if len(rows) >= 500:  # a name has over a hundred forms
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    schema = "name string, country string, node bigint, full boolean, forms array<struct<form:bigint,role:tinyint,tier:tinyint,short:boolean>>"
    distinct = names.where(F.length(F.trim("name")) > 0).select("name", "country").distinct()
    return spread(distinct).mapInPandas(write, schema)


def _stars(members: DataFrame) -> DataFrame:
    """(a, b) that join the nodes of each form: within a country, and those without a country to the only one.

    ``members``: form, country, node. A node without a country in a form of several countries stays alone there.
    """
    by_country = members.groupBy("form", "country").agg(F.min("node").alias("rep"), F.max("node").alias("other"))
    by_form = by_country.groupBy("form").agg(
        F.count("country").alias("countries"),
        F.min(F.when(F.col("country").isNotNull(), F.col("rep"))).alias("only"),
        F.min(F.when(F.col("country").isNull(), F.col("rep"))).alias("none"),
    )
    busy = by_country.where("rep < other").select(F.col("form").alias("f"), F.col("country").alias("c"), "rep", F.lit(True).alias("several"))
    torn = by_form.where("countries > 1 and none is not null").select(F.col("form").alias("t"))
    same = members.join(busy, (members["form"] == busy["f"]) & members["country"].eqNullSafe(busy["c"])).join(torn, F.col("form") == F.col("t"), "left")
    same = same.where("country is not null or t is null").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    lone = by_form.where("countries = 1 and none is not null").select(F.col("none").alias("a"), F.col("only").alias("b"))
    return same.unionByName(lone).where("a <> b").distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label) of each node that has an edge: the smallest node of its component.

    Each round gives a node the smallest label among its neighbours and then the label of its label, so a chain of
    n nodes takes about log n rounds. Raises if ``rounds`` don't suffice.
    """
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = hooked.select(F.col("node").alias("u"), F.col("label").alias("jump"))
        new = cut_lineage(hooked.join(up, hooked["label"] == up["u"], "left").select("node", "was", F.least("label", F.coalesce("jump", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def _relabel(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by its label where ``labels`` has one."""
    of = labels.select(F.col("node").alias("__n"), F.col("label").alias("__l"))
    return df.join(of, df[column] == F.col("__n"), "left").withColumn(column, F.coalesce("__l", column)).drop("__n", "__l")


#: Least share of the best owner in the rarity of all that a name shares with anybody.
SHARE = 0.75


def _shared(seekers: DataFrame, owners: DataFrame, total: int) -> DataFrame:
    """(label, tier, form, place, w, owners): each form of a name (label) that somebody owns, with its rarity and the number of
    its owners in that place: a struct of a country (or none), null for anywhere."""
    here = owners.groupBy("form", "country").agg(F.count("*").alias("n"), F.countDistinct("label").alias("owners"))
    everywhere = owners.groupBy("form").agg(F.count("*").alias("m"), F.countDistinct("label").alias("mo"))
    nowhere = here.where("country is null").select(F.col("form").alias("g"), F.col("n").alias("k"), F.col("owners").alias("ko"))
    own = here.where("country is not null").select(F.col("form").alias("f"), F.col("country").alias("c"), "n", "owners")
    none = F.col("country").isNull()
    found = seekers.join(everywhere, "form").join(nowhere, F.col("form") == F.col("g"), "left").join(own, (F.col("form") == F.col("f")) & (F.col("country") == F.col("c")), "left")
    pick = lambda a, b, c: F.when(none, F.col(a)).otherwise(F.coalesce(b, c))
    place = F.when(~none, F.struct(F.when(F.col("n").isNotNull(), F.col("country")).alias("of")))
    return found.select("label", "tier", "form", place.alias("place"), F.log(F.lit(float(total)) / pick("m", "n", "k")).alias("w"), pick("mo", "owners", "ko").alias("owners")).where("owners is not null")


def _scored(shared: DataFrame, owners: DataFrame) -> DataFrame:
    """(label, tier, owner, score) of all pairs in ``shared``, with their columns."""
    of = owners.select(F.col("form").alias("f"), F.col("country").alias("c"), F.col("label").alias("owner")).distinct()
    placed = shared.where("place is not null").join(of, (F.col("form") == F.col("f")) & F.col("place.of").eqNullSafe(F.col("c")))
    anywhere = shared.where("place is null").join(of.select("f", "owner").distinct(), F.col("form") == F.col("f"))
    each = placed.select("label", "tier", "owner", "w").unionByName(anywhere.select("label", "tier", "owner", "w"))
    return each.groupBy("label", "tier", "owner").agg(F.sum("w").alias("score"))


def scores(seekers: DataFrame, owners: DataFrame, total: int) -> DataFrame:
    """(label, tier, owner, score): the rarity of the rewritings that a name (label) shares with each owner.

    ``seekers``: form, tier, country, label; ``owners``: form, country, label; ``total``: number of names. Owners of the
    same country come first, then those without one; a name without a country takes owners of all. Every owner of a form
    gets the score.
    """
    return _scored(_shared(seekers, owners, total), owners)


def _owned(seekers: DataFrame, owners: DataFrame, total: int) -> DataFrame:
    """(a, b): the label of a seeker and that of its owner: the best in the first tier of forms that anybody owns.

    A form that m names own adds m times its rarity to all that is given and once to an owner. Where the rarities, each once,
    are less than SHARE of all, no owner can have that share: known from sums, without pairs. The forms of the others have few
    owners, as their rarities times owners are at most 1 / SHARE of the rarities; so the pairs grow with the names.
    """
    shared = written(_shared(seekers, owners, total))
    sums = shared.groupBy("label", "tier").agg(F.sum(F.greatest("w", F.lit(0.0))).alias("most"), F.sum(F.col("w") * F.col("owners")).alias("all"))
    first = sums.groupBy("label").agg(F.min(F.struct("tier", "most", "all")).alias("t")).select("label", "t.*")
    near = cut_lineage(first.where(F.col("most") >= (SHARE - 1e-9) * F.col("all")).select("label", "tier", "all"))  # sums differ in their last digits
    tops = _scored(shared.join(near.select("label", "tier"), ["label", "tier"]), owners).groupBy("label", "tier").agg(F.max(F.struct("score", "owner")).alias("top"))
    best = tops.join(near, ["label", "tier"]).where(F.col("top.score") >= (SHARE - 1e-9) * F.col("all"))
    return best.where("top.owner <> label").select(F.col("label").alias("a"), F.col("top.owner").alias("b"))


def link_names(names: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(source, id, person): the person of each row of ``names``: source, id, name, country (any code system).

    ``known``: (source, id, entity) may say which rows belong together for other reasons; rows with the same entity are
    one person. Rows with a null or blank name, or one without letters, are persons of their own unless known. The same
    name in two countries is never linked. Rows that repeat give repeated results.
    """
    rows = names.select("source", F.col("id").cast("string").alias("id"), "name", country_code(F.col("country")).alias("country"))
    spelled = written(name_forms(rows))
    total = max(2, spelled.count())
    each = spelled.select("node", "country", "full", F.inline("forms"))
    edges = _stars(each.where(F.col("role") == ROLES["same"]).select("form", "country", "node").distinct())
    w = spelled.select(F.col("name").alias("n"), F.col("country").alias("c"), "node")
    named = rows.join(w, (rows["name"] == F.col("n")) & rows["country"].eqNullSafe(F.col("c")), "left")
    own = F.xxhash64(F.lit("row"), "source", "id")
    named = cut_lineage(named.select("source", "id", F.coalesce("node", own).alias("node")))
    if known is not None:
        entity = known.select("source", F.col("id").cast("string").alias("id"), F.xxhash64(F.lit("entity"), "entity").alias("b"))
        edges = edges.unionByName(entity.join(named, ["source", "id"]).select(F.col("node").alias("a"), "b").distinct())
    first = components(edges)
    # Names written out: nicknames and other orders seek the one person who can be written so.
    labelled = written(_relabel(each.where(F.col("role") != ROLES["same"]).select("form", "role", "tier", "short", "country", F.col("node").alias("label")), "label", first))
    seek, owns = F.col("role") == ROLES["seek"], F.col("role") == ROLES["own"]
    part = lambda df, which: df.where(which).select("form", "tier", "country", "label")
    whole = labelled.where("not short")
    second = components(_owned(part(whole, seek), part(whole, owns), total))
    # Short names seek theirs, unless something else has made them one person with a name written out.
    short = _relabel(labelled.where("short"), "label", second)
    spoken = _relabel(spelled.where("full").select(F.col("node").alias("label")), "label", first).distinct()
    seekers = cut_lineage(part(short, seek).join(_relabel(spoken, "label", second).distinct(), "label", "left_anti"))
    third = cut_lineage(_owned(seekers, part(short, owns), total))
    # Those that nobody owns are linked to one another by their own form.
    left = seekers.where(F.col("tier") == EXACT).join(third.select(F.col("a").alias("label")), "label", "left_anti")
    fourth = _stars(left.select("form", "country", F.col("label").alias("node")).distinct())
    last = components(third.unionByName(fourth))
    out = _relabel(_relabel(_relabel(named, "node", first), "node", second), "node", last)
    return out.select("source", "id", F.col("node").alias("person"))


def pairs_of(linked: DataFrame) -> DataFrame:
    """(a, b), smaller id first, of all rows of one person; ``linked``: id, person. For results that are pairs."""
    a = linked.select("person", F.col("id").alias("a"))
    b = linked.select("person", F.col("id").alias("b"))
    return a.join(b, "person").where("a < b").select("a", "b").distinct()
