"""Records that stand in several splits, the same or nearly so (problem 6).

Evaluation records are hashed word by word (n-grams of length one: the measure
ignores word order, so longer n-grams would lose pairs), repeated words being
numbered.  If two records agree in a share t of the longer one's words, then of
any ``floor((1-t)·n) + c`` words of the evaluation record at least ``c`` stand in
the other record.  The rarest such words are its probes.  Where the evaluation
set is small enough, which is counted first, probes and word lists are broadcast
and one scan of the training texts finds hits, computes exact agreement and
containment, and emits nothing but overlaps.  Larger sets are partitioned by probe
hash with the training words instead; both ways give the same rows.  Exact copies
among the evaluation records are one class.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernmill.operators.skew import hot_counts, hot_keys, salted, salted_lookup
from kernmill.session import stage

THRESHOLD = 0.8
MIN_HITS = 4
HOT_ROWS = 20_000
#: Evaluation sets of at most so many words (8 bytes each) and classes are broadcast; larger ones are partitioned.
BROADCAST_WORDS, BROADCAST_CLASSES = 8_000_000, 1_000_000
#: Probe hits looked at together, which bounds the memory of a scan.
HITS_AT_ONCE = 2_000_000
_WORDS = regex.compile(r"[\p{L}\p{N}]+").findall


def _bag(text: str) -> np.ndarray:
    """Sorted 64-bit hashes of (word, how often it has stood before)."""
    out = [
        xxhash.xxh64_intdigest(f"{w}\x00{i}")
        for w, n in Counter(_WORDS(text.lower())).items()
        for i in range(n)
    ]
    return np.sort(np.array(out, dtype=np.uint64).view(np.int64))


def record_text(df: DataFrame) -> DataFrame:
    """``desc`` and all context sentences joined by line breaks; nulls are left out."""
    return df.withColumn("_text", F.concat_ws("\n", "desc", F.transform("contexts", lambda c: c["sentence"])))


def bags(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, words, bag_hash, bag``: number of words, hash of the multiset, the multiset itself.

    A null or wordless text has 0 words and an empty bag.
    """

    def run(batches):
        for b in batches:
            sets = [_bag(t) if t else np.empty(0, np.int64) for t in b.column(1).to_pylist()]
            off = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(flat, pa.int64())),
                ],
                names=["id", "words", "bag_hash", "bag"],
            )

    return df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "id bigint, words int, bag_hash string, bag array<bigint>"
    )


def _classes(b: DataFrame) -> DataFrame:
    """One row per distinct non-empty bag: ``cls`` (hash of the bag), words, bag."""
    return b.where("words > 0").groupBy(F.col("bag_hash").alias("cls")).agg(F.first("words").alias("words"), F.first("bag").alias("bag"))


def _scaled(threshold: float) -> tuple[int, int]:
    """Parts per 1e9 of the longer record that must agree, and of the evaluation record that may be missing."""
    return round(threshold * 1_000_000_000), math.floor((1 - threshold) * 1e9 + 0.5)


@dataclass
class Probes:
    """Evaluation classes in arrays: word lists and, per probe word, the classes it stands for."""

    cls: list
    words: np.ndarray
    need: np.ndarray
    begin: np.ndarray  # of each class in flat
    flat: np.ndarray
    tok: np.ndarray  # distinct probe words, ascending
    at: np.ndarray  # of each probe word in owner
    owner: np.ndarray


def make_probes(classes: pa.Table, threshold: float) -> Probes:
    """Probes of a table ``cls, words, bag``: of each class its rarest words, rarity counted over all classes."""
    bags_ = classes["bag"].combine_chunks() if classes.num_rows else pa.array([], pa.list_(pa.int64()))
    bags_ = bags_.combine_chunks() if isinstance(bags_, pa.ChunkedArray) else bags_
    words = classes["words"].to_numpy().astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(words)]).astype(np.int64)
    flat = bags_.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    missing = words * _scaled(threshold)[1] // 1_000_000_000
    need = np.minimum(MIN_HITS, words - missing)
    owner = np.repeat(np.arange(len(words)), words)
    _, of, df = np.unique(flat, return_inverse=True, return_counts=True)
    by_rarity = np.lexsort((flat, df[of] if len(flat) else of, owner))
    place = np.arange(len(flat)) - np.repeat(begin[:-1], words)
    probe = by_rarity[place < np.repeat(missing + need, words)]
    probe = probe[np.argsort(flat[probe], kind="stable")]
    tok, at = np.unique(flat[probe], return_index=True)
    return Probes(classes["cls"].to_pylist(), words, need, begin, flat, tok, np.append(at, len(probe)), owner[probe])


def scan_texts(texts: list, p: Probes, threshold: float) -> list[tuple[int, int, int, int]]:
    """(place in ``texts``, class, common words, words) of each overlap; equal texts are looked at once."""
    first: dict[str, list[int]] = {}
    for i, t in enumerate(texts):
        if t:
            first.setdefault(t, []).append(i)
    groups = list(first.values())
    sets = [_bag(t) for t in first]
    share, _ = _scaled(threshold)
    out: list[tuple[int, int, int, int]] = []
    if not len(p.tok) or not sets:
        return out
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), sizes)
    at = np.searchsorted(p.tok, flat)
    at[at == len(p.tok)] = 0
    hit = p.tok[at] == flat
    row, at = row[hit], at[hit]
    fan = p.at[at + 1] - p.at[at]
    total = np.cumsum(fan)
    begin = 0
    while begin < len(row):
        # whole records up to the bound, one record at least
        before = total[begin - 1] if begin else 0
        end = max(int(np.searchsorted(total, before + HITS_AT_ONCE, "right")), begin + 1)
        if end < len(row):
            cut = int(np.searchsorted(row, row[end], "left"))
            end = cut if cut > begin else int(np.searchsorted(row, row[begin], "right"))
        f = fan[begin:end]
        ends = np.cumsum(f)
        inner = np.arange(ends[-1]) - np.repeat(ends - f, f)
        who = p.owner[np.repeat(p.at[at[begin:end]], f) + inner]
        pair, hits = np.unique(np.repeat(row[begin:end], f) * len(p.cls) + who, return_counts=True)
        r, e = pair // len(p.cls), pair % len(p.cls)
        n, m = sizes[r], p.words[e]
        ok = (hits >= p.need[e]) & (np.minimum(n, m) * 1_000_000_000 >= np.maximum(n, m) * share)
        for i, c in zip(r[ok].tolist(), e[ok].tolist()):
            own = p.flat[p.begin[c] : p.begin[c + 1]]
            place = np.searchsorted(sets[i], own)
            place[place == len(sets[i])] = 0
            common = int((sets[i][place] == own).sum())
            if common * 1_000_000_000 >= max(len(own), len(sets[i])) * share:
                out += [(k, c, common, len(sets[i])) for k in groups[i]]
        begin = end
    return out


def scan_training(training: DataFrame, classes: DataFrame, id_col: str, text_col: str, threshold: float) -> DataFrame:
    """``e_cls, t_id, common, e_words, t_words``: one narrow pass over the training texts, classes broadcast."""
    known = training.sparkSession.sparkContext.broadcast(make_probes(classes.select("cls", "words", "bag").toArrow(), threshold))
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    names = ["e_cls", "t_id", "common", "e_words", "t_words"]

    def run(batches):
        p = known.value
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(p.cls[c], ids[i], common, int(p.words[c]), n) for i, c, common, n in scan_texts(b.column(1).to_pylist(), p, threshold)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return training.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(
        run, "e_cls string, t_id bigint, common int, e_words int, t_words int"
    )


def class_pairs(evaluation: DataFrame, training: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of bag classes: ``e_cls, t_cls, common, e_words, t_words`` with common/longer >= threshold.

    Both inputs are tables of ``_classes``.  Complete for any threshold in (0, 1].
    """
    share, spare = _scaled(threshold)
    missing = F.floor(F.col("words").cast("long") * spare / 1_000_000_000).cast("int")
    need = F.least(F.lit(MIN_HITS), F.col("words") - missing)
    probes = missing + need
    # lengths of a matching pair differ by 1/threshold at most: neighbouring classes of this logarithm
    size_class = lambda n: F.floor(F.log(n) / (math.log(1 / threshold) * 1.000001) if threshold < 1 else n).cast("int")
    t_tok = training.select(F.col("cls").alias("t_cls"), "words", F.explode("bag").alias("tok"))
    e_tok = evaluation.select("cls", F.explode("bag").alias("tok"))
    # how often each evaluation word stands in training classes, counted before anything is joined
    counted = t_tok.groupBy("tok").agg(F.count(F.lit(1)).alias("f"))
    freq = stage(e_tok.select("tok").distinct().join(counted, "tok", "left").select("tok", F.coalesce("f", F.lit(0)).alias("f")), "wordfreq")
    ranked = (
        salted_lookup(e_tok, freq, "tok", F.col("cls"), hot_keys(e_tok, "tok", HOT_ROWS))
        .groupBy("cls")
        .agg(F.sort_array(F.collect_list(F.struct("f", "tok"))).alias("by_rarity"))
        .join(evaluation.select("cls", "words"), "cls")
        .withColumn("need", need)
        .select("cls", "words", "need", F.slice("by_rarity", F.lit(1), probes).alias("p"))
    )
    near = F.array(*[size_class(F.col("words")) + i for i in (-1, 0, 1)]) if threshold < 1 else F.array(size_class(F.col("words")))
    probe = stage(
        ranked.select(F.col("cls").alias("e_cls"), F.col("words").alias("e_words"), "need", F.explode("p.tok").alias("tok"),
                      near.alias("near")).select("e_cls", "e_words", "need", "tok", F.explode("near").alias("size")), "probe",
    )
    scan = t_tok.withColumn("size", size_class(F.col("words")))
    # words that stand in many training classes are spread by class
    hot = hot_counts(freq, "tok", "f", HOT_ROWS)
    hits = (
        salted(probe, "tok", hot)
        .join(salted(scan, "tok", hot, F.col("t_cls")), ["tok", "size", "_salt"])
        .where((F.col("words") >= F.col("e_words") * threshold) & (F.col("e_words") >= F.col("words") * threshold))
        .groupBy("e_cls", "t_cls")
        .agg(F.count(F.lit(1)).alias("hits"), F.first("need").alias("need"))
        .where("hits >= need")
        .select("e_cls", "t_cls")
    )
    e_bag = evaluation.select(F.col("cls").alias("e_cls"), F.col("words").alias("e_words"), F.col("bag").alias("e_bag"))
    t_bag = training.select(F.col("cls").alias("t_cls"), F.col("words").alias("t_words"), F.col("bag").alias("t_bag"))
    scored = hits.join(t_bag, "t_cls").join(e_bag, "e_cls").select(
        "e_cls", "t_cls", F.size(F.array_intersect("e_bag", "t_bag")).alias("common"), "e_words", "t_words"
    )
    return scored.where(
        F.col("common").cast("long") * 1_000_000_000
        >= F.greatest("e_words", "t_words").cast("long") * share
    )


def split_overlaps(
    evaluation: DataFrame, training: DataFrame, id_col: str = "ex_id", threshold: float = THRESHOLD, broadcast_words: int = BROADCAST_WORDS
) -> dict[str, DataFrame]:
    """Overlaps of evaluation records with training records.

    Returns ``links`` (``e_cls, t_id, common, e_words, t_words, containment``: an
    evaluation class and a training record, with the part of the evaluation record
    that stands in it) and ``members`` (``cls, id`` of the evaluation records).
    Records without words match nothing.  Repeated rows count each; null ids stay
    null; empty tables give no rows; extra columns are not read.
    """
    b = stage(bags(record_text(evaluation), id_col, "_text"), "bags")
    classes = stage(_classes(b), "classes")
    size = classes.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("w"), F.count(F.lit(1)).alias("n")).first()
    if size["w"] <= broadcast_words and size["n"] <= BROADCAST_CLASSES:
        links = scan_training(record_text(training), classes, id_col, "_text", threshold)
    else:
        t = stage(bags(record_text(training), id_col, "_text"), "bags")
        pairs = stage(class_pairs(classes, stage(_classes(t), "classes"), threshold), "pairs")
        members = t.where("words > 0").select(F.col("bag_hash").alias("t_cls"), F.col("id").alias("t_id"))
        hot = hot_keys(members, "t_cls", HOT_ROWS)
        links = salted_lookup(members, pairs, "t_cls", F.col("t_id"), hot).select("e_cls", "t_id", "common", "e_words", "t_words")
    return {
        "links": links.withColumn("containment", F.col("common") / F.col("e_words")),
        "members": b.where("words > 0").select(F.col("bag_hash").alias("cls"), "id"),
    }


def expand_pairs(found: dict[str, DataFrame]) -> DataFrame:
    """Pairs of record ids ``e_id, t_id, common, containment`` from links and memberships."""
    links = stage(found["links"], "links")
    members = found["members"].withColumnsRenamed({"cls": "e_cls", "id": "e_id"})
    hot = hot_keys(links, "e_cls", HOT_ROWS)
    return salted_lookup(links, members, "e_cls", F.col("t_id"), hot).select("e_id", "t_id", "common", "containment")


def overlap_counts(found: dict[str, DataFrame]) -> DataFrame:
    """``id, n_training``: how many training records each overlapping evaluation record meets; no pair is expanded."""
    per = found["links"].groupBy(F.col("e_cls").alias("cls")).agg(F.count(F.lit(1)).alias("n_training"))
    members = found["members"]
    return salted_lookup(members, per, "cls", F.col("id"), hot_keys(members, "cls", HOT_ROWS)).select("id", "n_training")
