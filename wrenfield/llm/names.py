"""Problem 4: variant spellings of names typed by people.

A name is read into the kind of school it says (from words, abbreviations and initials, all with typing errors) and its
proper part, without places, given names and legal forms. Names of one kind whose proper parts are within a few edits of
each other are linked by a pigeonhole segment join.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wrenfield.llm.graph import components
from wrenfield.session import partitions_for, shuffled_in, spooled

# Words that tell the kind of a school, with usual abbreviations. Misspellings are found by their edits.
KIND_WORDS = {
    "school": "sch schl skool", "international": "int intl intnl intern internat", "british": "br brit", "academy": "acad acdmy aca", "college": "coll col", "high": "hgh h", "bilingual": "biling",
    "primary": "pri prim", "grammar": "gram gr", "community": "comm cmty", "world": "wld", "preparatory": "prep", "senior": "sr snr", "american": "amer", "secondary": "sec",
    "nursery": "nur", "institute": "inst", "kindergarten": "kg",
}
# Initials of kinds.
INITIALS = {
    "bis": "british international|bilingual international", "is": "international", "ia": "academy international", "bs": "british|bilingual", "ps": "primary|preparatory",
    "hs": "high", "gs": "grammar", "ws": "world", "cs": "community", "ss": "senior|secondary", "ba": "academy british", "bc": "british college", "ic": "college international",
}
# Words that name no school.
EMPTY_WORDS = set("the of and for at in a an ltd pte llc inc co plc limited trust foundation campus branch group saint st snt ste sainte san santa".split())
# Given names with their short forms.
GIVEN_NAMES = {
    "alexander": "alex alexr alec sandy xander", "andrew": "andy drew", "anthony": "tony", "benjamin": "ben", "catherine": "cathy", "charles": "charlie chuck",
    "christopher": "chris", "daniel": "dan danny", "david": "dave", "edward": "ed eddie ted teddy ned edwd", "elizabeth": "liz lizzie beth betty eliza bess eliz", "frances": "fran fanny",
    "frederick": "fred freddie freddy fredk", "george": "geo", "henry": "harry hank", "james": "jim jimmy jas", "john": "jack johnny jno", "joseph": "joe jos", "josephine": "jo josie",
    "katherine": "kate kathy katie kath kat", "margaret": "maggie peggy meg marg marge margt", "michael": "mike mick", "nicholas": "nick", "patricia": "pat patty", "philip": "phil",
    "rebecca": "becky", "richard": "dick rick ricky rich richd", "robert": "bob bobby rob robbie robt", "samuel": "sam", "stephen": "steve", "susan": "sue susie",
    "theodora": "dora theo thea", "theodore": "", "thomas": "tom tommy thos", "victoria": "vicky tori", "william": "will bill billy willy wm liam",
}

_KIND = {a: kind for kind, more in KIND_WORDS.items() for a in (kind, *more.split())}
_GIVEN = {a for name, more in GIVEN_NAMES.items() for a in (name, *more.split())}
_LETTERS = str.maketrans({"ł": "l", "đ": "d", "ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})


def plain(text: str) -> str:
    """Lower case without accents."""
    text = unicodedata.normalize("NFKD", text.lower().translate(_LETTERS)).lower().translate(_LETTERS)
    return "".join(c for c in text if not unicodedata.combining(c))


def edits(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b, or most + 1 if there are more; banded."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    far = most + 1
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [far] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row[j] = best
        if min(row) > most:
            return far
        before, last = last, row
    return min(last[-1], far)


def _kind_of(word: str, last: bool) -> str | None:
    """The kind that a word means, if any; a cut word may stand last."""
    if word in _KIND:
        return _KIND[word]
    if last and len(word) >= 2:
        for kind in KIND_WORDS:
            if kind.startswith(word) and (len(word) >= 2):
                return kind
    if len(word) >= 4:
        for kind in KIND_WORDS:
            if edits(word, kind, 1 if len(kind) < 8 else 2) <= (1 if len(kind) < 8 else 2):
                return kind
    return None


def _is_given(word: str) -> bool:
    return word in _GIVEN or len(word) >= 5 and any(edits(word, name, 1) <= 1 for name in GIVEN_NAMES if abs(len(name) - len(word)) <= 1)


def name_reader(places: list[str]):
    """A function from a name to (kinds, proper part, cut). ``kinds`` are the kinds it may mean, of which initials leave
    more than one; ``cut`` says that the proper part stands last, so its end may be missing. ``places`` are names of places
    that may follow or stand within."""
    words_of = lambda t: re.sub(r"[^a-z0-9]+", " ", t).strip()
    spelled = {form for p in places if p for form in (words_of(plain(p)), words_of(plain(p).replace("-", ""))) if form}
    towns = sorted(spelled, key=len, reverse=True)
    town = re.compile(r"(?:^| )(?:" + "|".join(towns) + r")(?= |$)") if towns else None
    without = lambda t: town.sub(" ", t).strip() if town else t
    is_place = lambda t: bool(t) and (without(t) == "" or len(t) >= 3 and any(x.startswith(t) for x in towns))
    memo: dict[tuple[str, bool], str | None] = {}

    def kind_of(word: str, last: bool) -> str | None:
        if (word, last) not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[word, last] = _kind_of(word, last)
        return memo[word, last]

    def hyphened(m: re.Match) -> str:
        parts = m[0].split("-")
        return " ".join(parts) if all(kind_of(p, False) for p in parts) else "".join(parts)

    def read(name: str) -> tuple[list[str], str, bool]:
        text = plain(re.sub(r"\([^)]*(?:\)|$)", " ", name))
        text = re.sub(r"(?<=[a-z])['’`´](?=[a-z])", "", text)
        text = re.sub(r"\b((?:[a-z]\.){2,})", lambda m: m[0].replace(".", ""), text)
        text = re.sub(r"[a-z]+(?:-[a-z]+)+", hyphened, text)
        flat = words_of(text)
        bare = without(flat)
        if any(w not in EMPTY_WORDS and not kind_of(w, False) for w in bare.split()):
            flat = bare
        if text.count(",") == 1:  # what follows a comma belongs in front, unless it is a place
            head, tail = (words_of(t) for t in text.split(","))
            flat = without(head) if is_place(tail) else f"{without(tail)} {without(head)}"
        words = [w for w in flat.split() if w not in EMPTY_WORDS]
        if len(words) > 1 and len(words[-1]) >= 4 and not kind_of(words[-1], False) and any(e.startswith(words[-1]) for e in (*EMPTY_WORDS, *towns)):
            words.pop()
        joined: list[str] = []
        for w in words:  # a word of the kind that was typed in two
            if joined and joined[-1] + w in KIND_WORDS and not (kind_of(joined[-1], False) and kind_of(w, False)):
                joined[-1] += w
            else:
                joined.append(w)
        kinds, rest, choice = set(), [], None
        for i, w in enumerate(joined):
            last = i == len(joined) - 1 and i > 0
            if w in INITIALS and len(joined) > 1:
                choice = INITIALS[w].split("|")
            elif (kind := kind_of(w, last)) is not None:
                kinds.add(kind)
            else:
                rest.append(w)
        if len(rest) > 1 and _is_given(rest[0]):
            rest = rest[1:]
        elif len(rest) > 2 and len(rest[0]) == 1:
            rest = rest[1:]
        proper = [w for w in rest if len(w) > 1] or rest
        cut = bool(proper) and bool(kinds or choice) and words_of(text).endswith(proper[-1])
        if len(kinds) > 1 or choice:
            kinds.discard("school")
        own = " ".join(sorted(kinds))
        options = [" ".join(sorted({*own.split(), *c.split()})) for c in choice] if choice else [own]
        return options, "".join(proper), cut

    return read


#: A null kind alternative never arises; names without any word have no proper part and link to nothing.
READING = "name string, kinds array<string>, proper string, cut boolean"


def read_names(names: DataFrame, places: list[str], name: str = "name", partitions: int | None = None) -> DataFrame:
    """(name, kinds, proper, cut) of each distinct non-null name. ``places`` is a dimension of a few hundred names; names are
    read in ``partitions`` tasks, by default as many as the session's shuffles have."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = name_reader(places)
        for batch in batches:
            rows = [(n, *reader(n)) for n in batch["name"]]
            yield pd.DataFrame(rows, columns=["name", "kinds", "proper", "cut"])

    distinct = names.select(F.col(name).alias("name")).where("name is not null").distinct()
    # Spread anew: distinct names are few bytes for much work, which adaptive execution would put into one task.
    return distinct.repartition(partitions or int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("name")).mapInPandas(read, READING)


def edits_allowed(length: Column, k: int = 2) -> Column:
    """How many edits two proper parts may be apart, by the length of the shorter: one up to five letters, else ``k``."""
    return F.when(length <= 5, 1).otherwise(k)


def segments(length: Column, k: int = 2) -> Column:
    """array(struct(part, start, size)): the cut of a text of this length into one segment more than edits are allowed, of
    nearly equal length; ``start`` counts from 0."""
    parts = edits_allowed(length, k) + 1
    base, longer = F.floor(length / parts).cast("int"), parts - length % parts  # segments from ``longer`` on have one letter more
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(i.alias("part"), (i * base + F.greatest(i - longer, F.lit(0))).alias("start"), (base + (i >= longer).cast("int")).alias("size")))


def near_pairs(nodes: DataFrame, k: int = 2) -> DataFrame:
    """(kind, proper, other, edits): pairs of different proper parts of one kind that are within ``k`` edits (insert, delete,
    replace), each pair once, or within one if the shorter has at most five letters. Single letters are near nothing.

    Pigeonhole: k edits leave one of k + 1 segments of the shorter part whole, at most k places from where it was; the
    inverted index of segments is an equi-join, with ranges of both lengths. All survivors are verified by a banded edit
    distance. Frequent segments of short parts are split by salts, as many as their index has hundreds of rows.
    """
    one = nodes.where("length(proper) > 1").select("kind", "proper", F.length("proper").alias("len")).distinct()
    cut = one.select("kind", F.col("proper").alias("other"), F.col("len").alias("size"), F.explode(segments(F.col("len"), k)).alias("s"))
    index = cut.select("kind", "other", "size", F.col("s.part").alias("part"), F.expr("substring(other, s.start + 1, s.size)").alias("piece"))
    # The longer of a pair looks for the shorter.
    shorter = one.select("kind", "proper", "len", F.explode(F.sequence(F.greatest(F.lit(2), F.col("len") - k), F.col("len"))).alias("size")).where(F.col("len") - F.col("size") <= edits_allowed(F.col("size"), k))
    looked = shorter.select("kind", "proper", "len", "size", edits_allowed(F.col("size"), k).alias("k"), F.explode(segments(F.col("size"), k)).alias("s"))
    looked = looked.select("kind", "proper", "size", F.col("s.part").alias("part"), F.col("s.size").alias("n"), F.explode(F.sequence(F.greatest(F.lit(0), F.col("s.start") - F.col("k")), F.least(F.col("len") - F.col("s.size"), F.col("s.start") + F.col("k")))).alias("at"))
    probe = looked.select("kind", "proper", "size", "part", F.expr("substring(proper, at + 1, n)").alias("piece")).distinct()
    by = ["kind", "size", "part", "piece"]
    # Merged, as sizes are guessed from files: small ones, whose names come to many times their bytes when cut into pieces, would be broadcast.
    salts = index.groupBy(*by).agg(F.ceil(F.count("*") / 200).cast("int").alias("salts")).hint("merge")
    salted_index = index.join(salts, by).withColumn("salt", F.pmod(F.xxhash64("other"), F.col("salts")).cast("int")).drop("salts")
    salted_probe = probe.join(salts, by).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    # Of two parts of one length both find each other; the larger keeps the pair.
    met = salted_probe.join(salted_index.hint("merge"), [*by, "salt"]).where("proper <> other and (length(proper) > length(other) or proper > other)").select("kind", "proper", "other").distinct()
    return met.select("*", F.levenshtein("proper", "other", k).alias("edits")).where("edits >= 0").where(F.col("edits") <= edits_allowed(F.length("other"), k))


def cut_pairs(nodes: DataFrame, least: int = 4) -> DataFrame:
    """(kind, proper, other): proper parts that may be cut, with the longer parts of their kind that begin with them."""
    stem = F.substring("proper", 1, least)
    short = nodes.where(F.col("cut") & (F.length("proper") >= least)).select("kind", F.col("proper").alias("other"), stem.alias("stem")).distinct()
    long = nodes.where(F.length("proper") > least).select("kind", "proper", stem.alias("stem")).distinct()
    return long.join(short.hint("merge"), ["kind", "stem"]).where("length(proper) > length(other) + 1 and startswith(proper, other)").select("kind", "proper", "other")


def _plain_places(places: list[str]) -> tuple[str, str, list[str]]:
    """Letters with accents, the same without, and the places in plain spelling."""
    accented = [c for c in map(chr, range(0xC0, 0x1F00)) if len(plain(c)) == 1 and plain(c) != c and plain(c).isascii() and plain(c).isalpha()]
    return "".join(accented), "".join(map(plain, accented)), sorted({re.sub(r"[^a-z0-9]+", " ", plain(p)).strip() for p in places if p} - {""})


def known_place(city: Column, places: list[str]) -> Column:
    """The plain spelling of a city if it is one of ``places``, else null: so sets of it are bounded."""
    accented, bare, known = _plain_places(places)
    spelled = F.trim(F.regexp_replace(F.lower(F.translate(city, accented, bare)), r"[^a-z0-9]+", " "))
    return F.when(spelled.isin(*known) if known else F.lit(False), spelled)


def name_clusters(mentions: DataFrame, places: list[str], k: int = 2) -> DataFrame:
    """(name, cluster): names of one cluster mean the same school.

    ``mentions`` has ``name``, ``country`` and ``place`` (both from closed lists, or null), in any number of rows. Names of
    one reading are linked; other names are linked if their proper parts are near (``near_pairs``) or one may be cut off and
    is the beginning of spellings of one name only (``cut_pairs``), and neither their countries nor their places exclude each other. Initials that may mean
    two kinds mean the one that a near and surely read name has. Null names have no row.
    """
    seen = mentions.where("name is not null").groupBy("name", "country", "place").agg(F.count("*").alias("n"))
    told = spooled(seen.groupBy("name").agg(F.sum("n").alias("n"), F.collect_set("country").alias("countries"), F.collect_set("place").alias("places")))
    # Distinct names are few beside their mentions: from here on shuffles follow their number.
    partitions = partitions_for(told.sparkSession, told.count())
    with shuffled_in(told.sparkSession, partitions):
        return spooled(_clusters(told, places, k, partitions))


def _clusters(named: DataFrame, places: list[str], k: int, partitions: int) -> DataFrame:
    """``name_clusters`` of distinct names with their numbers, countries and places."""
    read = spooled(read_names(named, places, partitions=partitions).join(named.hint("merge"), "name"))

    options = read.select("name", F.explode("kinds").alias("kind"), "proper", "cut", "n", "countries", "places", (F.size("kinds") == 1).alias("sure"))
    nodes = options.where("proper <> ''").groupBy("kind", "proper").agg(F.max("sure").alias("sure"), F.sum("n").alias("n"))
    pairs = near_pairs(nodes, k)
    near = spooled(pairs.union(pairs.select("kind", F.col("other"), F.col("proper"), "edits")).union(nodes.select("kind", "proper", F.col("proper").alias("other"), F.lit(0).alias("edits"))))

    sure = nodes.where("sure").select("kind", F.col("proper").alias("other"), F.col("n").alias("weight"))
    votes = options.where("not sure and proper <> ''").select("name", "kind", "proper").join(near.hint("merge"), ["kind", "proper"]).join(sure.hint("merge"), ["kind", "other"])
    voted = votes.groupBy("name").agg(F.min_by("kind", F.struct("edits", -F.col("weight"), "kind")).alias("voted"))
    # A name whose kind is cut off means the one kind there is with its proper part.
    only = nodes.where("sure and kind <> ''").groupBy("proper").agg(F.count("*").alias("k"), F.min("kind").alias("only")).where("k = 1").select("proper", "only")
    own_kind = F.coalesce("voted", F.when(F.col("kinds")[0] == "", F.col("only")), F.col("kinds")[0])
    chosen = spooled(read.join(voted.hint("merge"), "name", "left").join(only.hint("merge"), "proper", "left").select("name", own_kind.alias("kind"), "proper", "cut", "n", "countries", "places"))

    told = spooled(
        chosen.where("proper <> ''")
        .groupBy("kind", "proper")
        .agg(F.max("cut").alias("cut"), F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_list("countries"))).alias("countries"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    )
    one = told.select("kind", "proper", F.col("countries").alias("ca"), F.col("places").alias("pa"), F.col("n").alias("na")).hint("merge")
    two = told.select("kind", F.col("proper").alias("other"), F.col("countries").alias("cb"), F.col("places").alias("pb")).hint("merge")
    agree = lambda a, b: (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)
    fits = agree("ca", "cb") & agree("pa", "pb")
    typed = near.where("proper > other").join(one, ["kind", "proper"]).join(two, ["kind", "other"]).where(fits)
    ended = spooled(cut_pairs(told).join(one, ["kind", "proper"]).join(two, ["kind", "other"]).where(fits & F.arrays_overlap("ca", "cb")).select("kind", "proper", "other", "na"))
    # The longer names that it may be the beginning of must be spellings of one: the commonest, and such as are near it.
    best = ended.groupBy("kind", "other").agg(F.max_by("proper", F.struct("na", "proper")).alias("best"))
    whole = ended.select("kind", "other", "proper").join(best.hint("merge"), ["kind", "other"])
    apart = whole.join(near.select("kind", "proper", F.col("other").alias("best")).hint("merge"), ["kind", "proper", "best"], "left_anti").select("kind", "other").distinct()
    ended = best.join(apart.hint("merge"), ["kind", "other"], "left_anti").select("kind", "other", F.col("best").alias("proper"))
    node = lambda c: F.concat_ws("|", "kind", c)
    edges = typed.select(node("proper").alias("a"), node("other").alias("b")).union(ended.select(node("proper").alias("a"), node("other").alias("b")))
    roots = components(edges)
    own = chosen.withColumn("node", F.when(F.col("proper") != "", node("proper")).otherwise(F.col("name")))
    return own.join(roots.hint("merge"), "node", "left").select("name", F.coalesce("root", "node").alias("cluster"))
