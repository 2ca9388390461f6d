"""Protected names: variants of names, stored as keyed hashes only, and found in text by hashing its word sequences."""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ..functions.masking import Hmac20, held, hmac_sha256_20
from ..functions.text import LINE_LIMIT, LINES, normalize_words, words_of

PARTICLES = ("DA", "DE", "DO", "DAS", "DOS", "E", "D")
#: Endings of company names, and words too common in them to identify one alone. Parameters of the functions below; fixed values.
LEGAL_SUFFIXES = ("LTDA", "SA", "S", "A", "EIRELI", "ME", "EPP", "MEI", "CIA", "EM", "RECUPERACAO", "JUDICIAL", "FALIDA", "MASSA")
GENERIC = tuple("""
BANCO COMPANHIA EMPRESA EMPRESAS SERVICOS SERVICO INDUSTRIA INDUSTRIAS COMERCIO GRUPO BRASIL BRASILEIRA BRASILEIRO
SAO PAULO RIO JANEIRO MINAS GERAIS NACIONAL ASSOCIACAO SINDICATO CONSTRUTORA CONSTRUCOES TRANSPORTES TRANSPORTE
LOGISTICA SOLUCOES ADMINISTRACAO ADMINISTRADORA HOSPITAL INSTITUTO CENTRO MUNICIPIO PREFEITURA ESTADO FUNDACAO
COOPERATIVA SEGURANCA VIGILANCIA LIMPEZA CONSERVACAO ATACADISTA DISTRIBUIDORA COMERCIAL TECNOLOGIA SISTEMAS
PARTICIPACOES ENGENHARIA SAUDE EDUCACIONAL EDUCACAO ENSINO MINISTERIO UNIAO FEDERAL CAIXA ECONOMICA SUPERMERCADO
SUPERMERCADOS MERCADO LOJAS LOJA RESTAURANTE ALIMENTOS ALIMENTACAO AUTO POSTO POSTOS TERCEIRIZACAO RECURSOS HUMANOS
GESTAO CONSULTORIA ASSESSORIA TELECOMUNICACOES TELEFONIA ENERGIA ELETRICA ELETRICIDADE DISTRIBUICAO GERAL
INTERNACIONAL GLOBAL NOVA NOVO PRIMEIRA SUL NORTE LESTE OESTE CLINICA FARMACIA DROGARIA BAR CASA SOCIEDADE
""".split())
WINDOW = 8


def is_valid_variant(words: Column, generic: tuple[str, ...] = GENERIC) -> Column:
    """Two words at least, none of one letter, and not only generic words and particles."""
    common = F.array(*(F.lit(x) for x in (*generic, *PARTICLES)))
    return (F.size(words) >= 2) & F.forall(words, lambda w: F.length(w) >= 2) & (F.size(F.array_except(words, common)) > 0)


def _no_digits(words: Column) -> Column:
    return F.filter(words, lambda w: ~w.rlike("^[0-9]+$"))


def _joined(variants: list[Column], generic: tuple[str, ...]) -> Column:
    valid = F.filter(F.array_compact(F.array(*variants)), lambda v: is_valid_variant(v, generic))
    return F.array_distinct(F.transform(valid, lambda v: F.array_join(v, " ")))


def person_variants(words: Column, generic: tuple[str, ...] = GENERIC) -> Column:
    """Array of variants of a person's name: all words, first and last, first and second (the last two without particles)."""
    all_words = _no_digits(words)
    plain = F.filter(all_words, lambda w: ~w.isin(*PARTICLES))
    two = F.size(plain) >= 2
    short = [F.when(two, F.array(F.get(plain, F.lit(0)), F.element_at(plain, -1))), F.when(two, F.slice(plain, 1, 2))]
    return F.when(F.size(all_words) >= 2, _joined([all_words, *short], generic)).otherwise(F.array().cast("array<string>"))


def company_variants(words: Column, generic: tuple[str, ...] = GENERIC, suffixes: tuple[str, ...] = LEGAL_SUFFIXES) -> Column:
    """Array of variants of a company's name: all words, without legal endings, and the first two of these if they say enough."""
    all_words = _no_digits(words)
    # Drop words from the end for as long as they are endings: what is left goes up to the last word that isn't one.
    places = F.filter(F.transform(all_words, lambda w, i: F.when(~w.isin(*suffixes), i + 1)), lambda i: i.isNotNull())
    core = F.slice(all_words, F.lit(1), F.coalesce(F.array_max(places), F.lit(0)))
    first, second = F.get(core, F.lit(0)), F.get(core, F.lit(1))
    start = F.when(~(first.isin(*generic) & second.isin(*generic)) & ~second.isin(*PARTICLES), F.slice(core, 1, 2))
    enough = F.size(core) >= 2
    return _joined([all_words, F.when(enough, core), F.when(enough, start)], generic)


def build_variants(names: DataFrame, generic: tuple[str, ...] = GENERIC, suffixes: tuple[str, ...] = LEGAL_SUFFIXES) -> DataFrame:
    """Distinct (kind, name_key, variant) of a table (name, kind: person or company); names that normalise alike are one.

    ``generic`` and ``suffixes`` are the lists for company names, in normalised words.
    """
    keyed = names.withColumn("_w", normalize_words(F.col("name"))).withColumn("name_key", F.array_join("_w", " ")).filter("name_key <> ''")
    keyed = keyed.dropDuplicates(["kind", "name_key"])
    variants = F.when(F.col("kind") == "company", company_variants(F.col("_w"), generic, suffixes)).otherwise(person_variants(F.col("_w"), generic))
    return keyed.select("kind", "name_key", F.explode(variants).alias("variant"))


def build_protected(names: DataFrame, key: bytes, generic: tuple[str, ...] = GENERIC, suffixes: tuple[str, ...] = LEGAL_SUFFIXES) -> tuple[DataFrame, DataFrame]:
    """(distinct hashes, counts of names and variants by kind). Neither holds a name.

    ``pair`` and ``first`` are hashes of a variant's first two words and of its first, ``third`` of the first three of longer ones: a
    scan hashes only words and pairs to begin with, and more than three words only where ``third`` says so. The columns may be
    dropped, at the price of hashing all pairs or all sequences.
    """
    variants = build_variants(names, generic, suffixes)
    counts = variants.groupBy("kind").agg(F.countDistinct("name_key").alias("names"), F.countDistinct("variant").alias("variants"))
    start = lambda n: F.substring_index("variant", " ", n)
    begin = [hmac_sha256_20(start(2), key).alias("pair"), hmac_sha256_20(start(1), key).alias("first"), hmac_sha256_20(F.when(start(3) != F.col("variant"), start(3)), key).alias("third")]
    return variants.select("variant").distinct().select(hmac_sha256_20(F.col("variant"), key).alias("hash"), *begin), counts


def _greedy(hits: Column) -> Column:
    """Hits (start, n) that a scan from the left takes: at each place the longest, then on behind it."""
    longest = F.array_sort(hits, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["n"] - a["n"]))
    empty = F.struct(F.lit(0).alias("next"), F.array().cast("array<struct<start:int,n:int>>").alias("out"))
    return F.aggregate(
        longest, empty,
        lambda s, h: F.when(h["start"] >= s["next"], F.struct((h["start"] + h["n"]).alias("next"), F.array_append(s["out"], h).alias("out"))).otherwise(s),
        lambda s: s["out"],
    )


#: Bits of a filter: 16 a stored pair or word, and no more than 2**27 (16 MB), of which 2**21 words come to the driver.
FEWEST_BITS, MOST_BITS, BITS_A_PAIR = 1 << 16, 1 << 27, 16
#: Hex digits of a hash that serve as its places in the filter: the hash is keyed and uniform, so parts of it are hashes of their own.
#: Whole variants have other places than beginnings: a pair that only begins a variant isn't one.
_PLACES = (0, 6, 12)
_COLUMNS = {"pair": _PLACES, "first": _PLACES, "hash": (2, 8, 10), "third": (1, 7, 11)}
#: Words that a worker remembers, and words of texts that it looks at in one go.
REMEMBERED, WORDS_AT_ONCE = 300_000, 1_000_000


def pair_filter(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of the stored variants, pairs, first words and first three words, as far as ``hashes`` has these: 64-bit words of a bitmap.

    One job sets the bits of the largest bitmap, combining them before the shuffle; the driver gets its words that aren't empty, and folds
    the bitmap for as long as BITS_A_PAIR bits a hash are left.
    """
    places = F.array(*(F.pmod(F.conv(F.substring(c, i + 1, 8), 16, 10).cast("long"), F.lit(MOST_BITS)) for c in _COLUMNS if c in hashes.columns for i in _COLUMNS[c]))
    place = hashes.select(F.explode(places).alias("at")).filter("at is not null")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("at"), F.lit(64)).cast("int"))
    words = place.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(MOST_BITS // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    stored = int(np.bitwise_count(out).sum()) // len(_PLACES) + 1
    while len(out) * 64 > FEWEST_BITS and len(out) * 32 >= BITS_A_PAIR * stored:
        half = len(out) // 2
        out = out[:half] | out[half:]
    return out


class _Codes(dict[str, int]):
    """Numbers of words, from 1."""

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self) + 1
        return code


class NameScanner:
    """Hashes of the word sequences of texts that may be stored names: those whose beginnings and which themselves pass the filter, if there is one, by the columns that it is made of.

    Many words of texts are looked at in one go, each different sequence of them once: for each length, those sequences go on to the next one whose beginnings pass.
    """

    def __init__(self, key: bytes, words: np.ndarray | None, generic: tuple[str, ...], columns: tuple[str, ...] = ("pair", "hash")):
        self.of, self.bits, self.common = Hmac20(key).digest, words, frozenset((*generic, *PARTICLES))
        self.columns = frozenset(columns if words is not None else ())
        self._forget()

    def _forget(self) -> None:
        self.codes, self.words, self.long, self.first = _Codes(), [""], bytearray(1), bytearray(1)

    def _has(self, digests: bytearray, column: str) -> np.ndarray:
        """Which of the hashes the filter has; all of them where it wasn't made of the column."""
        d = np.frombuffer(digests, np.uint8).reshape(-1, 10).astype(np.uint64)
        out = np.ones(len(d), bool)
        for i in _COLUMNS[column] if column in self.columns else ():
            byte, odd = divmod(i, 2)
            number = np.zeros(len(d), np.uint64)
            for k in range(byte, byte + 4 + odd):
                number = number << np.uint64(8) | d[:, k]
            at = (number >> np.uint64(4 * odd)) & np.uint64(64 * len(self.bits) - 1)
            out &= (self.bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out

    def passes(self, message: str) -> bool:
        """Whether a word or pair is in the filter."""
        return bool(self._has(bytearray(self.of(message)), "pair")[0])

    def _learn(self) -> None:
        """Which of the words that are new may stand in a name, and begin one."""
        new = list(islice(self.codes, len(self.words) - 1, None))
        self.words += new
        self.long += bytes(len(w) > 1 for w in new)
        self.first += (self._has(bytearray(b"".join(map(self.of, new))), "first") & np.fromiter((len(w) > 1 for w in new), bool, len(new))).astype(np.uint8).tobytes()

    def _sequences(self, codes: array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, places in ``codes``, hashes) of sequences that can be a variant. A code of 0 ends a line."""
        self._learn()
        c, long, first = np.frombuffer(codes, np.int32), np.frombuffer(bytes(self.long), bool), np.frombuffer(bytes(self.first), bool)
        # Places where a sequence begins that may go on, and which of the sequences ``known`` it is.
        at, known = np.flatnonzero(first[c]), self.words
        which = c[at]
        for n in range(2, WINDOW + 1):
            more = at + n - 1 < len(c)
            more[more] = long[c[at[more] + n - 1]]  # with a word of one letter no longer sequence from here is valid either
            at, which = at[more], which[more]
            if not len(at):
                return
            different, which = np.unique(which.astype(np.int64) << 32 | c[at + n - 1], return_inverse=True)
            message = lambda x: f"{known[x >> 32]} {self.words[x & 0xFFFFFFFF]}"  # noqa: B023, E731
            digests = bytearray()
            for x in different.tolist():
                digests += self.of(message(x))
            on = self._has(digests, "pair") if n == 2 else self._has(digests, "third") if n == 3 else np.ones(len(different), bool)
            valid = self._has(digests, "hash") & (on if n == 2 else True)
            for i in np.flatnonzero(valid):
                valid[i] = not self.common.issuperset(message(int(different[i])).split(" "))
            found = valid[which]
            yield n, at[found], np.frombuffer(bytes(digests), "V10")[which[found]]
            known = [message(x) for x in different[on].tolist()]
            go = on[which]
            at, which = at[go], (np.cumsum(on) - 1)[which[go]]

    def find(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(place of the text from 0, line from 1, first word from 0 times 16 and words, hash) of each sequence of 2 to WINDOW words that can be a variant, in arrays."""
        codes, lines = array("i"), (array("i"), array("i"), array("i"))

        def found() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            row, number, begin = (np.array(x, np.int32) for x in lines)
            for n, at, digests in self._sequences(codes):
                line = np.searchsorted(begin, at, "right") - 1
                yield row[line], number[line], ((at - begin[line]) * 16 + n).astype(np.int32), digests

        for i, text in enumerate(texts):
            for number, line in enumerate(LINES.split(text or ""), 1):
                words = words_of(line[:LINE_LIMIT])
                if len(words) < 2:
                    continue
                for column, value in zip(lines, (i, number, len(codes)), strict=True):
                    column.append(value)
                codes.extend(map(self.codes.__getitem__, words))
                codes.append(0)
                if len(codes) >= WORDS_AT_ONCE:
                    yield from found()
                    codes, lines = array("i"), (array("i"), array("i"), array("i"))
                    if len(self.codes) > REMEMBERED:
                        self._forget()
        if codes:
            yield from found()


def _sequences(texts: DataFrame, key: bytes, words: np.ndarray | None, generic: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """(id, line, at, hash) of a table (id, text): each sequence that may be a stored name; ``at`` is its first word times 16 and its words, ``hash`` bytes."""
    secret, bitmap = held(texts.sparkSession, key), texts.sparkSession.sparkContext.broadcast(words)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = NameScanner(secret.value, bitmap.value, generic, columns)
        for batch in batches:
            for row, line, at, digests in scanner.find(x.as_py() for x in batch.column(1)):
                hashes = pa.Array.from_buffers(pa.binary(10), len(row), [None, pa.py_buffer(digests.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(line), pa.array(at), hashes], ["id", "line", "at", "hash"])

    schema = StructType([texts.schema["id"], StructField("line", IntegerType()), StructField("at", IntegerType()), StructField("hash", BinaryType())])
    return texts.mapInArrow(find, schema)


def scan_protected(df: DataFrame, hashes: DataFrame, key: bytes | None, allow: DataFrame | None = None, id_col: str = "id", text: str = "text", generic: tuple[str, ...] = GENERIC) -> DataFrame:
    """Hits (id, line, start, words) of protected names in text; ``start`` counts words from 0.

    ``hashes`` has a column hash; ``allow`` a column sequence of normalised words that never count, while
    shorter ones inside still do. Without a key nothing could be found, so that is an error.

    One pass over the texts hashes the word at each place, and the two words there, and looks for them in a Bloom filter of the stored names' beginnings;
    only from places that pass sequences of 2 to 8 words are hashed, and only those that the filter has as whole names leave the pass and are joined with
    the stored ones. No word, name or key leaves it. If ``hashes`` has no column first all pairs are hashed, without pair all sequences. Only hits are
    grouped again. So what is shuffled is the hits twice, and few others.
    """
    if not key:
        raise ValueError("protected names can't be matched without their key")
    texts = df.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    found = _sequences(texts, key, pair_filter(hashes), generic, tuple(c for c in _COLUMNS if c in hashes.columns))
    if allow is not None:
        found = found.join(allow.select(F.unhex(hmac_sha256_20(F.col("sequence"), key)).alias("hash")).distinct(), "hash", "left_anti")
    hits = found.join(hashes.select(F.unhex("hash").alias("hash")).distinct(), "hash", "left_semi")
    # Dealt out first: hits of a line come from many tasks, so that there is nothing to put together before.
    lines = hits.select("id", "line", "at").repartition("id", "line").groupBy("id", "line")
    place = F.struct(F.shiftright("at", 4).alias("start"), F.col("at").bitwiseAND(15).alias("n"))
    taken = lines.agg(_greedy(F.collect_list(place)).alias("h"))
    return taken.select("id", "line", F.explode("h").alias("h")).select("id", "line", "h.start", F.col("h.n").alias("words"))


def lookup_names(names: DataFrame, hashes: DataFrame, key: bytes | None) -> DataFrame:
    """(name, protected) of each name of a table."""
    hit = scan_protected(names.select(F.col("name").alias("id"), F.col("name").alias("text")), hashes, key).select(F.col("id").alias("name")).distinct()
    return names.join(hit.withColumn("protected", F.lit(True)), "name", "left").withColumn("protected", F.coalesce("protected", F.lit(False)))
