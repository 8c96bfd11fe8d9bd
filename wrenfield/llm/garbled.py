"""Problem 10: garbled text from wrong character encoding.

The channel: some stretch of a text was written as bytes of one encoding and read as another. Its inverse reads each damaged
chunk as a lattice of bytes, in which lost ones are wildcards, and forth to text. Each distinct chunk of the corpus is read
back once by every channel; the words of a reading are weighed by their frequencies in the corpus against those that stand
there, and Viterbi search over a document's chunks, with the channels as states, decides which stretches are read back by
which. What stood in place of wildcards is the most frequent word of the corpus that the channel turns into what is seen.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenfield.llm.bitmap import kept_by_bitmap
from wrenfield.session import spooled

LOST = "\ufffd"
#: UTF-8 that was read as one of these, once or twice. cp1252 stands for ISO 8859-1 too: its gaps are control characters.
READ_AS = ("cp1252", "cp1250", "mac_roman", "cp850", "cp437", "cp1251", "iso8859_2")
#: What was read as cp1252.
WRITTEN_IN = ("cp1251", "koi8_r", "cp1256", "gbk", "big5", "shift_jis", "euc_kr", "cp1250", "iso8859_2")
#: (name, encoding it was read as, encoding it was written in, times).
CHANNELS = [(f"utf-8 as {w}" + " twice" * (n - 1), w, "utf-8", n) for w in READ_AS for n in (1, 2)] + [(f"{r} as cp1252", "cp1252", r, 1) for r in WRITTEN_IN]
#: One-byte text read as UTF-8: every byte beyond ASCII was lost.
ALL_LOST = "one byte as utf-8"
#: Log odds: for each character that reading back saves, as chance rarely makes whole UTF-8; against the beginning of a
#: stretch; against a stretch of a one-byte reading without a known word; for a lost character, which no one writes. UNKNOWN
#: is the count of words that the corpus doesn't have.
FEWER, SWITCH, UNTOLD, GONE, UNKNOWN = 2.0, 3.0, 12.0, 3.5, 0.05
RUN = re.compile("[^\x00-\x7f]+")
#: Stretches without ASCII blanks that hold a character beyond ASCII; the pattern means the same in Java and Python.
CHUNK = r"(?<![^ \t\r\n\f\x0b])[\x00-\x08\x0e-\x1f\x21-\x7f]*+[^\x00-\x7f][^ \t\r\n\f\x0b]*+"
_INVISIBLE = set("\u00ad\u200b\u200c\u200d\u200e\u200f\ufeff\u3000\u00a0\ufffd")


class _OneByte:
    """A one-byte encoding: ``byte`` of each character (bytes without a character stand as control characters), ``gaps``, and
    ``apt``, which finds what may be UTF-8 read as this."""

    def __init__(self, encoding: str) -> None:
        self.byte: dict[str, int] = {}
        self.gaps: set[int] = set()
        for b in range(128, 256):
            try:
                self.byte.setdefault(bytes([b]).decode(encoding), b)
            except UnicodeDecodeError:
                self.gaps.add(b)
        for b in range(128, 160):
            self.byte.setdefault(chr(b), b)
        self.char = {b: c for c, b in reversed(self.byte.items())}
        group = lambda lo, hi: "".join(re.escape(c) for c, b in self.byte.items() if lo <= b <= hi)
        self.apt = re.compile(f"[{group(0xC2, 0xF4)}][{group(0x80, 0xBF)}{LOST}]")
        self.known = re.compile("[" + "".join(map(re.escape, self.byte)) + "]")


_ENCODINGS: dict[str, _OneByte] = {}


def _one_byte(encoding: str) -> _OneByte:
    if encoding not in _ENCODINGS:
        _ENCODINGS[encoding] = _OneByte(encoding)
    return _ENCODINGS[encoding]


def lattice(run: str, wrong: str) -> tuple[str, list[str]]:
    """(text, views): a run read back as UTF-8 where its bytes are UTF-8, the rest as it stands. A lost character within one
    is a wildcard; what it belonged to comes out as lost, and ``views`` has what is seen of each such."""
    code = _one_byte(wrong)
    out, views, i = [], [], 0
    while i < len(run):
        b = code.byte.get(run[i], 0)
        size = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
        tail = [None if c == LOST else code.byte.get(c, 0) for c in run[i + 1 : i + size]]
        read = run[i]
        if size > 1 and len(tail) == size - 1 and all(t is None or 0x80 <= t <= 0xBF for t in tail):
            try:  # any lost byte of a tail can be A0
                bytes([b, *(0xA0 if t is None else t for t in tail)]).decode("utf-8")
            except UnicodeDecodeError:
                pass
            else:
                read = run[i : i + size]
                if None in tail:
                    views.append(read)
                    read = LOST
                else:
                    read = bytes([b, *tail]).decode("utf-8")
                i += size - 1
        elif run[i] == LOST:
            views.append(LOST)
        out.append(read)
        i += 1
    return "".join(out), views


def _mixed(text: str) -> bool:
    """If letters of two scripts are in one word, which no reading of a whole word has."""
    import regex

    return bool(regex.search(r"\p{Latin}\p{M}*(?!\p{Latin})[\p{Cyrillic}\p{Arabic}\p{Han}\p{Hangul}\p{Hiragana}\p{Katakana}\p{Greek}]|[\p{Cyrillic}\p{Arabic}\p{Hangul}\p{Greek}]\p{M}*\p{Latin}", text))


def reread(chunk: str, wrong: str, right: str, times: int) -> tuple[str, int, list[str]] | None:
    """(text, characters fewer, views of lost characters) of a chunk with what the channel fits read back; null if it fits
    nothing."""
    new, views = chunk, []
    if right == "utf-8":
        for _ in range(times):
            if not _one_byte(wrong).apt.search(new):
                return None
            views, last = [], new

            def back(m: re.Match) -> str:
                text, own = lattice(m[0], wrong)
                views.extend(own)
                return text

            new = RUN.sub(back, new)
            if new == last:
                return None
    else:
        table = _one_byte(wrong).byte
        if not _one_byte(wrong).known.search(chunk):
            return None

        def other(m: re.Match) -> str:
            try:
                return bytes(table[c] for c in m[0]).decode(right)
            except (KeyError, UnicodeDecodeError):
                return m[0]

        new = RUN.sub(other, chunk)
        if LOST in chunk or _mixed(new):
            return None
    if new == chunk or not all(c.isprintable() or c in _INVISIBLE for c in new if c > "\x7f"):
        return None
    return new, len(chunk) - len(new), views


#: Before single characters and pairs of them among words.
SIGN = "\u0001"
_WORD = r"[\p{Han}\p{Hiragana}\p{Katakana}]|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}])[\p{L}\p{M}\p{N}\ufffd])+|[^\s\p{L}\p{M}\p{N}\x00-\x7f]"




def words_of(text: str) -> list[str]:
    """The words, single characters of scripts without blanks and single signs of a text, in lower case."""
    import regex

    return regex.findall(_WORD, text.lower())


def singles_of(text: str) -> list[str]:
    """Each character beyond ASCII, marked."""
    return [SIGN + c for c in text.lower() if c > "\x7f"]


def pairs_of(text: str) -> list[str]:
    """Each two neighbouring characters of which one is beyond ASCII, marked."""
    return [SIGN + a + b for a, b in itertools.pairwise(text.lower()) if a > "\x7f" or b > "\x7f"]


def read_chunks(chunks: DataFrame) -> DataFrame:
    """Of each distinct chunk (chunk, n) one row with its own words, and one for each channel that reads it in another way:
    the text, the words that come and go by it, the characters it saves and what is seen of lost ones. So that words which
    the corpus lacks can be told too, the characters that come and go count beside the words: in pairs, if there are as many
    on either side, else singly."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk, n in zip(batch["chunk"], batch["n"]):
                words, singles, pairs = words_of(chunk), singles_of(chunk), pairs_of(chunk)
                rows.append((chunk, n, None, None, words + singles + pairs, [], 0, []))
                if LOST in chunk:
                    rows.append((chunk, n, ALL_LOST, chunk, [], [], 0, [LOST] * chunk.count(LOST)))
                for name, wrong, right, times in CHANNELS:
                    made = reread(chunk, wrong, right, times)
                    if made is not None:
                        new, fewer, views = made
                        even = len(new) == len(chunk)
                        have, now = words + (pairs if even else singles), words_of(new) + (pairs_of(new) if even else singles_of(new))
                        come, go = Counter(now) - Counter(have), Counter(have) - Counter(now)
                        come, go = ([w for w in x.elements() if LOST not in w] for x in (come, go))
                        rows.append((chunk, n, name, new, come, go, fewer if right == "utf-8" else 0, views))
            yield pd.DataFrame(rows, columns=["chunk", "n", "channel", "new", "come", "go", "fewer", "views"])

    return chunks.mapInPandas(read, "chunk string, n bigint, channel string, new string, come array<string>, go array<string>, fewer int, views array<string>")


def weighed(read: DataFrame, corpus: DataFrame, size: int) -> DataFrame:
    """(chunk, channel, new, views, gain, told): the readings of ``read_chunks`` that may belong to a stretch, with the log
    odds of the words that come by them against those that go (without their own place); told if the corpus has one of
    those that come, with a letter beyond ASCII. ``corpus`` has word and n.

    Only readings of distinct chunks are shuffled here; adaptive skew joins split frequent words.
    """
    hypotheses = read.where("channel is not null")
    word = lambda c, side: F.transform(c, lambda w: F.struct(F.lit(side).alias("side"), w.alias("word")))
    asked = hypotheses.select("chunk", "channel", F.explode(F.concat(word("come", 1), word("go", -1))).alias("x")).select("chunk", "channel", "x.*")
    known = asked.join(corpus, "word", "left")
    count = F.coalesce("n", F.lit(0))
    own = F.when(F.col("side") < 0, F.greatest(count - 1, F.lit(0))).otherwise(count)
    gains = known.groupBy("chunk", "channel").agg(F.sum(F.col("side") * F.ln((own + UNKNOWN) / float(size))).alias("odds"), F.max((F.col("side") > 0) & ~F.startswith("word", F.lit(SIGN)) & (count > 0) & F.col("word").rlike(r"[\p{L}&&[^\x00-\x7f]]")).alias("told"))
    gain = F.coalesce("odds", F.lit(0.0)) + FEWER * F.col("fewer") + F.when(F.col("channel") == ALL_LOST, GONE).otherwise(0.0)
    sure = F.col("channel").startswith("utf-8") | (F.col("channel") == ALL_LOST)
    scored = hypotheses.join(gains, ["chunk", "channel"], "left").select("chunk", "channel", "new", "views", gain.alias("gain"), (sure | F.coalesce("told", F.lit(False))).alias("told"))
    # What costs more than a new stretch is never part of one.
    return scored.where(F.col("gain") > -SWITCH)


#: Of channels that lose characters: (name, encoding, bytes that are lost). ISO 8859-1 loses its control characters.
LOSSY = [(ALL_LOST, "", frozenset())] + [(name, wrong, frozenset(_one_byte(wrong).gaps)) for name, wrong, right, times in CHANNELS if right == "utf-8" and times == 1 and _one_byte(wrong).gaps]
LOSSY.append(("utf-8 as cp1252", "cp1252", frozenset(range(0x80, 0xA0))))


def _seen_as(word: str, wrong: str, gaps: frozenset[int]) -> str:
    """A word with each character that loses a byte when it is read as ``wrong`` as it is seen then."""
    if not wrong:
        return "".join(LOST if c > "\x7f" else c for c in word)
    char, out = _one_byte(wrong).char, []
    for c in word:
        own = c.encode("utf-8") if c > "\x7f" else b""
        out.append("".join(LOST if b in gaps else char[b] for b in own) if any(b in gaps for b in own) else c)
    return "".join(out)


def filled(scored: DataFrame, corpus: DataFrame) -> DataFrame:
    """(chunk, channel, guess): readings with lost characters, these guessed where the corpus has a word that the channel turns
    into what is seen; of several the most frequent."""
    import regex

    word_of = regex.compile(_WORD)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for chunk, channel, new, views in zip(batch["chunk"], batch["channel"], batch["new"], batch["views"]):
                view = iter(views)
                for m in word_of.finditer(new):
                    if LOST in m[0]:
                        seen = [next(view, LOST) if c == LOST else c.lower() for c in m[0]]
                        # By itself too: it may be a sign beside the word, or of a script without blanks.
                        rows += [(chunk, channel, m.start() + i, LOST, seen[i]) for i, c in enumerate(m[0]) if c == LOST and len(m[0]) > 1]
                        rows.append((chunk, channel, m.start(), m[0], "".join(seen)))
            yield pd.DataFrame(rows, columns=["chunk", "channel", "at", "token", "seen"])

    def turned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(channel, seen, w, n) for w, n in zip(batch["word"], batch["n"]) for channel, wrong, gaps in LOSSY if LOST in (seen := _seen_as(w, wrong, gaps))]
            yield pd.DataFrame(rows, columns=["channel", "seen", "word", "n"])

    lost = scored.where("size(views) > 0").select("chunk", "channel", "new", "views")
    asked = lost.mapInPandas(ask, "chunk string, channel string, at int, token string, seen string")
    words = corpus.where(~F.startswith("word", F.lit(SIGN)) & ~F.contains("word", F.lit(LOST))).mapInPandas(turned, "channel string, seen string, word string, n bigint")
    best = words.groupBy("channel", "seen").agg(F.max_by("word", F.struct("n", "word")).alias("word"))
    found = asked.join(best, ["channel", "seen"]).where(F.char_length("word") == F.char_length("token")).groupBy("chunk", "channel").agg(F.collect_list(F.struct("at", "token", "word")).alias("found"))

    @F.pandas_udf("string")
    def put(new: pd.Series, found: pd.Series) -> pd.Series:
        out = []
        for text, words in zip(new, found):
            chars = list(text)
            for x in sorted(words, key=lambda x: len(x["token"])):  # what fits a whole word stands last, so it holds
                rest = [c for c in x["token"] if c.isalpha()]
                for i, (c, w) in enumerate(zip(x["token"], x["word"])):
                    if c == LOST:
                        chars[x["at"] + i] = w.upper() if len(rest) > 1 and all(r.isupper() for r in rest) and len(w.upper()) == 1 else w
            out.append("".join(chars))
        return pd.Series(out, dtype=object)

    return lost.join(found, ["chunk", "channel"]).select("chunk", "channel", put("new", "found").alias("guess"))


def best_stretches(places: list[dict[str, tuple[float, bool]]]) -> tuple[float, list[str | None]]:
    """Viterbi over the chunks of a document: as it stands, or read back by a channel. ``places`` has of each chunk the gain of
    each channel that reads it in another way, and if that is told. Beginning a stretch costs ``SWITCH``, ending one in which
    nothing was told ``UNTOLD``. The best total gain, and the channel of each chunk that is read back."""
    channels = sorted({c for p in places for c in p})
    plain: tuple[float, tuple | None] = (0.0, None)  # score and path, a chain of (channel, path before)
    at: dict[tuple[str, bool], tuple[float, tuple | None]] = {}
    for i, place in enumerate(places):
        ends = max([plain, *((s - (0.0 if told else UNTOLD), path) for (_, told), (s, path) in at.items())], key=lambda x: x[0])
        new: dict[tuple[str, bool], tuple[float, tuple | None]] = {}
        for c in channels:
            gain, told = place.get(c, (0.0, False))
            options = [((c, was or told), at[c, was][0], at[c, was][1]) for was in (False, True) if (c, was) in at]
            if c in place:
                options.append(((c, told), ends[0] - SWITCH, ends[1]))
            for key, score, path in options:
                if key not in new or score + gain > new[key][0]:
                    new[key] = (score + gain, (i, c, path) if c in place else path)
        plain, at = ends, new
    total, path = max([plain, *((s - (0.0 if told else UNTOLD), path) for (_, told), (s, path) in at.items())], key=lambda x: x[0])
    out: list[str | None] = [None] * len(places)
    while path is not None:
        i, c, path = path
        out[i] = c
    return total, out


def restored(documents: DataFrame) -> DataFrame:
    """(doc_id, channel, text, lost) of every document a stretch of which was read in a wrong encoding.

    ``text`` is the original where nothing was lost; where characters were lost it holds the best guess (or the lost character
    still, where the corpus has no word that fits) and ``lost`` is true. ``channel`` names those of all stretches. Null and
    empty texts are no cases. Ids are taken to be unique.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text <> ''")
    chunked = spooled(docs.select("doc_id", F.regexp_extract_all("text", F.lit(CHUNK), F.lit(0)).alias("chunks")).where("size(chunks) > 0"))
    distinct = chunked.select(F.explode(F.array_distinct("chunks")).alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))
    # Spread anew, as distinct chunks are few bytes for much work: adaptive execution would put them into one task.
    read = spooled(read_chunks(distinct.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("chunk"))))
    corpus = spooled(read.where("channel is null").select(F.explode("come").alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")))
    scored = spooled(weighed(read, corpus, max(documents.count(), 1)))

    # Only what may be read back is shuffled; a chunk that very many documents have is split by adaptive skew joins.
    places = kept_by_bitmap(chunked.select("doc_id", F.posexplode("chunks").alias("at", "chunk")), "chunk", scored)
    paths = places.join(scored.select("chunk", "channel", "gain", "told"), "chunk").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "channel", "gain", "told", "chunk"))).alias("places"))

    @F.pandas_udf("struct<total:double, back:array<string>>")
    def walk(places: pd.Series) -> pd.DataFrame:
        rows = []
        for doc in places:
            by_place = [{x["channel"]: (x["gain"], bool(x["told"])) for x in own} for _, own in itertools.groupby(doc, key=lambda x: x["at"])]
            rows.append(best_stretches(by_place))
        return pd.DataFrame(rows, columns=["total", "back"])

    walked = paths.select("doc_id", "places", walk(F.transform("places", lambda x: F.struct(x["at"].alias("at"), x["channel"].alias("channel"), x["gain"].alias("gain"), x["told"].alias("told")))).alias("w")).where("w.total > 0")
    at = F.array_distinct(F.transform("places", lambda x: F.struct(x["at"].alias("at"), x["chunk"].alias("chunk"))))
    chosen = walked.select("doc_id", F.explode(F.arrays_zip(at.alias("at"), F.col("w.back").alias("channel"))).alias("x")).select("doc_id", "x.at.at", "x.at.chunk", "x.channel").where("channel is not null")
    made = chosen.join(scored.select("chunk", "channel", "new", F.size("views").alias("gone")), ["chunk", "channel"]).join(filled(scored, corpus), ["chunk", "channel"], "left")
    by_doc = made.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("at", F.coalesce("guess", "new")))).alias("made"), F.array_join(F.array_sort(F.collect_set("channel")), ", ").alias("channel"), (F.max("gone") > 0).alias("lost")
    )

    @F.pandas_udf("string")
    def rebuilt(texts: pd.Series, made: pd.Series) -> pd.Series:
        chunk, out = re.compile(CHUNK), []
        for text, new in zip(texts, made):
            new, i = dict(new), itertools.count()
            out.append(chunk.sub(lambda m: new.get(next(i), m[0]), text))
        return pd.Series(out, dtype=object)

    return docs.join(by_doc, "doc_id").select("doc_id", "channel", rebuilt("text", "made").alias("text"), (F.col("lost") | F.col("text").contains(LOST)).alias("lost"))
