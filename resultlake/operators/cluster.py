"""Clustering of result lists by shared phrases or by embedding vectors.

Token counts, scores and assignments are relational.  The greedy merging itself is sequential
within a query's list, which its maker limits, so it runs as one grouped function per query.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.dialect import SPARK, WHITE

MERGE, SIM, DUP, REPRINT = 0.55, 0.42, 0.94, 0.75
MAX_CLUSTER, MAX_DEPTH, MAX_BUCKET = 12, 3, 6
TEXT_WEIGHT, RANK_WEIGHT, SEM_WEIGHT, NOISE, SEM_NOISE = 0.7, 0.3, 0.45, 0.3, 0.32


def tokens(results: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """(query_id, idx, token) of titles."""
    return results.select("query_id", "idx", F.explode(F.expr(text.title_tokens(SPARK, "title", stop))).alias("token"))


def document_frequency(tokens_: DataFrame) -> DataFrame:
    """(query_id, token, df) of tokens that two results or more share."""
    return tokens_.groupBy("query_id", "token").agg(F.count("*").alias("df")).where("df >= 2")


def top_phrases(df: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent tokens of a query, ties in order of the token."""
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("df"), "token"))
    return df.withColumn("nth", nth).where(F.col("nth") <= k).select("query_id", F.expr("substr(token, 3)").alias("phrase"), "df", "nth")


def phrase_groups(members: dict[str, set[int]], merge: float = MERGE) -> list[set[int]]:
    """Merges token groups, largest first, into the first cluster that holds or resembles them."""
    clusters: list[set[int]] = []
    for _, own in sorted(members.items(), key=lambda kv: (-len(kv[1]), kv[0])):
        for c in clusters:
            both = len(own & c)
            if both == len(own) or both / len(own | c) >= merge:
                c |= own
                break
        else:
            clusters.append(set(own))
    return clusters


def by_phrase(results: DataFrame, merge: float = MERGE, stop: list[str] | None = None) -> DataFrame:
    """(query_id, cluster_id, idx): overlapping clusters of results that share title tokens.

    All results of a list count; how many it has is its maker's limit (``merge.merged``).
    """
    t = tokens(results, stop)
    often = t.join(document_frequency(t), ["query_id", "token"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members: dict[str, set[int]] = {}
        for token, idx in zip(pdf["token"], pdf["idx"], strict=True):
            members.setdefault(token, set()).add(int(idx))
        q = pdf["query_id"].iloc[0]
        rows = [(q, c, i) for c, own in enumerate(phrase_groups(members, merge)) for i in sorted(own)]
        return pd.DataFrame(rows, columns=["query_id", "cluster_id", "idx"])

    return often.select("query_id", "token", "idx").groupBy("query_id").applyInPandas(run, "query_id bigint, cluster_id int, idx bigint")


# --- vectors ---------------------------------------------------------------------------------


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v)
    return v / n if n else v


class Group:
    """A cluster under construction: members, their vector sum and folded duplicates."""

    def __init__(self, members, vectors):
        self.members = list(members)
        self.duplicates: list[tuple[int, int]] = []
        self.sum = vectors[self.members].sum(0)

    @property
    def centre(self):
        return _unit(self.sum)


def leaders(vectors: np.ndarray, sim: float = SIM, dup: float = DUP, folded: dict[int, int] | None = None) -> list[Group]:
    """Leader clustering in rank order; near-equal vectors fold into their nearest member."""
    groups: list[Group] = []
    for i, v in enumerate(vectors):
        if folded and i in folded:
            home = next((g for g in groups if folded[i] in g.members), None)
            if home:
                home.duplicates.append((i, folded[i]))
            continue
        scores = [float(v @ g.centre) for g in groups]
        best = int(np.argmax(scores)) if scores else -1
        if best >= 0 and scores[best] >= max(dup, 1e-12):
            g = groups[best]
            near = vectors[g.members] @ v
            g.duplicates.append((i, g.members[int(np.argmax(near))]))
        elif best >= 0 and scores[best] > 0 and scores[best] >= sim:
            groups[best].members.append(i)
            groups[best].sum = groups[best].sum + v
        else:
            groups.append(Group([i], vectors))
    return groups


def outliers(vectors: np.ndarray) -> list[int]:
    """Members whose median likeness lies below the lower fence of quartiles by floor index."""
    n = len(vectors)
    if n < 5:
        return []
    likeness = vectors @ vectors.T
    middle = np.array([np.sort(np.delete(likeness[i], i))[(n - 1) // 2] for i in range(n)])
    ordered = np.sort(middle)
    q1, q3 = ordered[int(n * 0.25)], ordered[int(n * 0.75)]
    return [i for i in range(n) if middle[i] < q1 - 1.5 * (q3 - q1)]


def subphrases(token_sets: list[set[str]]) -> list[list[int]] | None:
    """Groups by the most frequent CJK token of each member; None without structure."""
    n = len(token_sets)
    df: dict[str, int] = {}
    for ts in token_sets:
        for t in sorted(ts):
            df[t] = df.get(t, 0) + 1
    signs = [t for t, c in sorted(df.items(), key=lambda kv: (-kv[1], kv[0])) if 2 <= c <= max(2, n // 2) and t.startswith("c:")]
    groups: dict[str, list[int]] = {}
    rest = []
    for i, ts in enumerate(token_sets):
        sign = next((t for t in signs if t in ts), None)
        groups.setdefault(sign, []).append(i) if sign else rest.append(i)
    good = [g for g in groups.values() if len(g) >= 2]
    rest += [i for g in groups.values() if len(g) < 2 for i in g]
    if not good or max(map(len, good)) >= 0.85 * n:
        return None
    return good + [[i] for i in sorted(rest)]


def split_oversized(groups: list[Group], vectors, token_sets, limit: int = MAX_CLUSTER, depth: int = 0) -> list[Group]:
    """Clusters over ``limit`` lose their outliers, or part by subphrases; MAX_DEPTH times at most."""
    out = []
    for g in groups:
        parts = None
        if len(g.members) > limit and depth < MAX_DEPTH:
            odd = set(outliers(vectors[g.members]))
            if odd and len(odd) < len(g.members):
                parts = [[m for k, m in enumerate(g.members) if k in odd], [m for k, m in enumerate(g.members) if k not in odd]]
            elif found := subphrases([token_sets[m] for m in g.members]):
                parts = [[g.members[k] for k in p] for p in found]
        if parts is None:
            out.append(g)
            continue
        subs = sorted((Group(p, vectors) for p in parts), key=lambda s: -len(s.members))
        for i, of in g.duplicates:
            next((s for s in subs if of in s.members), subs[0]).duplicates.append((i, of))
        for s in subs:
            out += split_oversized([s], vectors, token_sets, limit, depth + 1)
    return out


def _merged(likeness: np.ndarray, steps: int, limit: int, heights: list | None) -> list[list[int]]:
    sets = [[i] for i in range(len(likeness))]
    d = likeness.astype(float).copy()
    np.fill_diagonal(d, -np.inf)
    done = 0
    while done < steps and len(sets) > 1:
        upper = np.where(np.triu(np.ones_like(d), 1) > 0, d, -np.inf)
        i, j = np.unravel_index(int(np.argmax(upper)), d.shape)
        best = d[i, j]
        if best <= 0:
            break
        if len(sets[i]) + len(sets[j]) > limit:
            d[i, j] = d[j, i] = -1.0
            continue
        if heights is not None:
            heights.append(float(best))
        a, b = len(sets[i]), len(sets[j])
        row = (a * d[i] + b * d[j]) / (a + b)
        row[i] = -np.inf
        d[i], d[:, i] = row, row
        d = np.delete(np.delete(d, j, 0), j, 1)
        d[i if i < j else i - 1, i if i < j else i - 1] = -np.inf
        sets[i] = sets[i] + sets[j]
        del sets[j]
        done += 1
    return sets


def average_linkage(vectors: np.ndarray, limit: int = MAX_BUCKET, least: float = SIM) -> list[list[int]]:
    """Average-linkage buckets, cut at the largest gap above the floor-index third quartile."""
    n = len(vectors)
    if n < 2:
        return [[i] for i in range(n)]
    likeness = vectors @ vectors.T
    heights: list[float] = []
    _merged(likeness, n - 1, limit, heights)
    pairs = np.sort(likeness[np.triu_indices(n, 1)])
    floor = max(least, pairs[int(len(pairs) * 0.75)])
    cut = len(heights)
    while cut > 0 and heights[cut - 1] < floor:
        cut -= 1
    gaps = [heights[i] - heights[i + 1] for i in range(cut - 1)]
    if gaps and max(gaps) > 0:
        cut = int(np.argmax(gaps)) + 1
    return [sorted(s) for s in _merged(likeness, cut, limit, None)]


def bucket_singletons(groups: list[Group], vectors, limit: int = MAX_BUCKET, least: float = SIM) -> list[Group]:
    """Three singletons or more join into average-linkage buckets."""
    single = [g for g in groups if len(g.members) == 1]
    if len(single) < 3:
        return groups
    buckets = average_linkage(np.stack([vectors[g.members[0]] for g in single]), limit, least)
    if len(buckets) == len(single):
        return groups
    out = [g for g in groups if len(g.members) > 1]
    for b in buckets:
        g = Group([single[i].members[0] for i in b], vectors)
        g.duplicates = [x for i in b for x in single[i].duplicates]
        out.append(g)
    return out


def by_vector(results: DataFrame, sim: float = SIM, dup: float = DUP, limit: int = MAX_CLUSTER, buckets: bool = True, reprints: DataFrame | None = None) -> DataFrame:
    """(query_id, cluster_id, idx, role, duplicate_of) of results (query_id, idx, vec, tokens).

    ``reprints`` (query_id, idx, duplicate_of) are folded before.  Rows of a query are clustered in
    order of idx; vectors must have unit length.
    """
    if reprints is not None:
        results = results.join(reprints.select("query_id", "idx", F.col("duplicate_of").alias("fold")), ["query_id", "idx"], "left")
    else:
        results = results.withColumn("fold", F.lit(None).cast("bigint"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx", ignore_index=True)
        ids = pdf["idx"].tolist()
        at = {v: k for k, v in enumerate(ids)}
        vectors = np.stack([np.asarray(v, float) for v in pdf["vec"]])
        folded = {k: at[int(f)] for k, f in enumerate(pdf["fold"]) if f == f and f is not None and int(f) in at}
        sets = [set(t) if t is not None else set() for t in pdf["tokens"]]
        groups = split_oversized(leaders(vectors, sim, dup, folded), vectors, sets, limit)
        if buckets:
            groups = bucket_singletons(groups, vectors, least=sim)
        q, rows = pdf["query_id"].iloc[0], []
        for c, g in enumerate(groups):
            rows += [(q, c, ids[m], "item", None) for m in g.members] + [(q, c, ids[m], "duplicate", ids[of]) for m, of in g.duplicates]
        return pd.DataFrame(rows, columns=["query_id", "cluster_id", "idx", "role", "duplicate_of"]).astype({"duplicate_of": "Int64"})

    return results.select("query_id", "idx", "vec", "tokens", "fold").groupBy("query_id").applyInPandas(run, "query_id bigint, cluster_id int, idx bigint, role string, duplicate_of bigint")


def reprints(results: DataFrame, low: float = REPRINT, high: float = DUP) -> DataFrame:
    """(query_id, idx, duplicate_of): later results that reprint an earlier one that itself stays.

    Near titles share a run of 12 characters and near descriptions one of 20, so results of a query
    that share such a run are compared (cosine within [low, high), then the exact rules); the fold
    in rank order is a grouped function.
    """
    from ..functions import vectors

    normal, bare = text.normalize_title(SPARK, "title"), f"substr({SPARK.sub('coalesce(`desc`, ' + chr(39) * 2 + ')', WHITE + '+')}, 1, 4096)"
    runs = F.expr(f"array_distinct(concat(transform(regexp_extract_all({normal}, '(?=(.{{12}}))', 1), g -> xxhash64('t', g)), transform(regexp_extract_all({bare}, '(?=(.{{20}}))', 1), g -> xxhash64('d', g))))")
    each = results.select("query_id", "idx", F.explode(runs).alias("run"))
    # a passage that results share is many runs of the same results: these are paired once
    alike = each.groupBy("query_id", "run").agg(F.sort_array(F.collect_set("idx")).alias("of")).where("size(of) > 1").select("query_id", "of").distinct()
    both = "flatten(transform(of, (x, k) -> transform(slice(of, k + 2, size(of)), y -> named_struct('i', x, 'j', y))))"
    near = alike.select("query_id", F.explode(F.expr(both)).alias("p")).select("query_id", "p.i", "p.j").distinct()
    a = results.select("query_id", F.col("idx").alias("i"), F.col("title").alias("ta"), F.col("desc").alias("da"), F.col("vec").alias("va"))
    b = results.select("query_id", F.col("idx").alias("j"), F.col("title").alias("tb"), F.col("desc").alias("db"), F.col("vec").alias("vb"))
    pairs = near.join(a, ["query_id", "i"]).join(b, ["query_id", "j"]).withColumn("sim", F.expr(vectors.dot(SPARK, "va", "vb"))).where((F.col("sim") >= low) & (F.col("sim") < high))
    told = pairs.where(F.expr(f"{text.near_title(SPARK, 'ta', 'tb')} OR {text.near_description(SPARK, 'da', 'db')}"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gone: dict[int, int] = {}
        for i, j in sorted(zip(pdf["i"], pdf["j"], strict=True)):
            if i not in gone and j not in gone:
                gone[j] = i
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]] * len(gone), "idx": list(gone), "duplicate_of": list(gone.values())})

    return told.select("query_id", "i", "j").groupBy("query_id").applyInPandas(run, "query_id bigint, idx bigint, duplicate_of bigint")


# --- scores ----------------------------------------------------------------------------------


def scored(members: DataFrame, results: DataFrame, text_scores: DataFrame | None = None) -> DataFrame:
    """(query_id, cluster_id, size, quality, rank_score, text_score, sem_score, score, low_relevance).

    ``members`` (query_id, cluster_id, idx); ``results`` has source_rank, source_count, quality and
    rel (null without vectors); ``text_scores`` (query_id, cluster_id, text_score).
    """
    rank = F.when(F.col("source_count") > 1, 1 - (F.col("source_rank") - 1) / (F.col("source_count") - 1)).otherwise(1.0)
    each = members.join(results.select("query_id", "idx", "quality", rank.alias("rank"), "rel"), ["query_id", "idx"])
    agg = each.groupBy("query_id", "cluster_id").agg(F.count("*").alias("size"), F.avg("quality").alias("quality"), F.avg("rank").alias("rank_score"), F.avg(F.when(F.col("rel").isNotNull(), F.greatest(F.lit(0.0), "rel"))).alias("sem_score"))
    agg = agg.join(text_scores, ["query_id", "cluster_id"], "left") if text_scores is not None else agg.withColumn("text_score", F.lit(0.0))
    t, r, s, q = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("text_score", "rank_score", "sem_score", "quality"))
    plain = (TEXT_WEIGHT * t + RANK_WEIGHT * r) * (0.5 + 0.5 * q)
    with_sem = (SEM_WEIGHT * s + TEXT_WEIGHT * (1 - SEM_WEIGHT) * t + RANK_WEIGHT * (1 - SEM_WEIGHT) * r) * (0.5 + 0.5 * q)
    out = agg.withColumn("text_score", t).withColumn("score", F.when(F.col("sem_score").isNull(), plain).otherwise(with_sem))
    return out.withColumn("low_relevance", (F.col("score") < NOISE) | F.coalesce(F.col("sem_score") < SEM_NOISE, F.lit(False)))


def text_scores(members: DataFrame, results: DataFrame) -> DataFrame:
    """(query_id, cluster_id, text_score): weighted share of members that hold each query token."""
    q = results.select("query_id", "query").distinct().select("query_id", F.explode(F.expr(text.query_tokens(SPARK, "query"))).alias("tw"))
    q = q.select("query_id", F.substring_index("tw", "=", 1).alias("token"), F.substring_index("tw", "=", -1).cast("double").alias("w"))
    base = q.groupBy("query_id").agg(F.sum(F.when(F.col("w") == 1, 1.0).otherwise(0.0)).alias("base"))
    whole = F.concat_ws(" ", "title", "desc")
    have = F.expr(f"concat(transform({text.grams(SPARK, 'whole', 2)}, g -> concat('c:', g)), transform({text.words_plain(SPARK, 'whole')}, w -> concat('e:', w)))")
    held = members.join(results.withColumn("whole", whole).select("query_id", "idx", have.alias("tokens")), ["query_id", "idx"])
    size = held.groupBy("query_id", "cluster_id").agg(F.count("*").alias("size"))
    hits = held.select("query_id", "cluster_id", F.explode("tokens").alias("token")).groupBy("query_id", "cluster_id", "token").agg(F.count("*").alias("hits"))
    total = hits.join(q, ["query_id", "token"]).join(size, ["query_id", "cluster_id"]).groupBy("query_id", "cluster_id").agg(F.sum(F.col("w") * F.col("hits") / F.col("size")).alias("total"))
    return size.join(total, ["query_id", "cluster_id"], "left").join(base, "query_id", "left").select("query_id", "cluster_id", F.when(F.col("base") > 0, F.least(F.lit(1.0), F.coalesce("total", F.lit(0.0)) / F.col("base"))).otherwise(0.0).alias("text_score"))


def assigned(members: DataFrame, scores: DataFrame) -> DataFrame:
    """Each result in its first cluster by score and size; scores keep their values."""
    order = Window.partitionBy("query_id", "idx").orderBy(F.desc("score"), F.desc("size"), "cluster_id")
    return members.join(scores.select("query_id", "cluster_id", "score", "size"), ["query_id", "cluster_id"]).withColumn("nth", F.row_number().over(order)).where("nth = 1").select("query_id", "cluster_id", "idx")


def uncovered(results: DataFrame, members: DataFrame) -> DataFrame:
    """Results that are in no cluster."""
    return results.join(members, ["query_id", "idx"], "left_anti")


# --- labels ----------------------------------------------------------------------------------


class Automaton:
    """Suffix automaton of a text: finds the longest run of another text that it holds, in one pass."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in text:
            new = self._state({}, self.length[last] + 1)
            at, last = last, new
            while at >= 0 and c not in self.next[at]:
                self.next[at][c] = new
                at = self.link[at]
            self.link[new] = 0 if at < 0 else self._owner(at, c)

    def _state(self, moves: dict[str, int], length: int, link: int = 0) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _owner(self, at: int, c: str) -> int:
        """The state that just the runs of ``at`` lead to by ``c``; parted from longer ones if need be."""
        to = self.next[at][c]
        if self.length[to] == self.length[at] + 1:
            return to
        apart = self._state(dict(self.next[to]), self.length[at] + 1, self.link[to])
        self.link[to] = apart
        while at >= 0 and self.next[at].get(c) == to:
            self.next[at][c] = apart
            at = self.link[at]
        return apart

    def longest(self, text: str) -> str:
        """The longest run of ``text`` that this text holds, of equals the one that ends first."""
        state = size = best = end = 0
        for i, c in enumerate(text, 1):
            while state and c not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            if c in self.next[state]:
                state, size = self.next[state][c], size + 1
            if size > best:
                best, end = size, i
        return text[end - best : end]


def common_span(a: str, b: str) -> str:
    """Longest common substring, the one that ends first in ``a``."""
    return Automaton(b).longest(a)


_EDGES = " _-|｜·•,，、;；:：()（）[]【】<>《》\"'“”…"


def _holds(title: str, part: str) -> bool:
    """Whether a title holds a part in any case; one of plain letters only as whole words."""
    if re.fullmatch("[a-zA-Z]+", part):
        return re.search(rf"(?<![a-z]){re.escape(part.lower())}(?![a-z])", title.lower()) is not None
    return part.lower() in title.lower()


def label(titles: list[str], top: str = "", most: int = 18) -> str:
    """A readable name of a cluster: a span that two titles share and most titles hold.

    A span counts its length, the titles that hold it (two at least) and 1.5 for holding ``top``,
    the cluster's most frequent token, which stands in where no span is left, written as the
    first title with it writes it.  One title is its own name.
    """
    if len(titles) == 1:
        return titles[0].strip()[:most]
    titles = [t[:200] for t in titles]
    points: dict[str, float] = {}
    automata = [Automaton(t) for t in titles]
    for i, a in enumerate(titles):
        for b in automata[i + 1 :]:
            for part in re.split(r"[,，;；:：。.!！?？…]+", b.longest(a).strip(_EDGES)):
                part = part.strip(_EDGES)
                if len(part) >= 2 and re.search(r"[A-Za-z一-鿿]", part) and part not in points:
                    held = sum(_holds(t, part) for t in titles)
                    if held >= 2:
                        points[part] = len(part) + held + (1.5 if top and top.lower() in part.lower() else 0)
    if points:
        return max(points, key=lambda p: (points[p], len(p)))[:most]
    home = next((t for t in titles if top and top.lower() in t.lower()), "")
    at = home.lower().find(top.lower())
    return (home[at : at + len(top)] if home else top)[:most]


def labels(members: DataFrame, results: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """(query_id, cluster_id, label) from titles without their sites' names."""
    from ..functions import col

    titled = members.join(results.select("query_id", "idx", col(text.label_title, "title").alias("title")), ["query_id", "idx"])
    held = members.join(tokens(results, stop), ["query_id", "idx"]).join(document_frequency(tokens(results, stop)), ["query_id", "token"])
    top = held.groupBy("query_id", "cluster_id").agg(F.max_by(F.expr("substr(token, 3)"), F.struct("df", F.length("token"), "token")).alias("top"))
    titled = titled.join(top, ["query_id", "cluster_id"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("idx")
        top = own["top"].iloc[0]
        return pd.DataFrame({"query_id": [own["query_id"].iloc[0]], "cluster_id": [own["cluster_id"].iloc[0]], "label": [label(own["title"].tolist(), top if isinstance(top, str) else "")]})

    return titled.groupBy("query_id", "cluster_id").applyInPandas(run, "query_id bigint, cluster_id int, label string")


# --- near duplicates of one source -----------------------------------------------------------


def farm_dedup(results: DataFrame, stem: str = "stem") -> DataFrame:
    """(query_id, idx, duplicate_of): rows of sites that copy each other, or reprints of a title.

    Same farm: different stems that share four characters, and 30 % of title bigrams; reprint: 55 %
    of title trigrams, four at least.  A later row folds into the first representative it copies.
    """
    g2, g3 = (F.expr(text.grams(SPARK, "title", n)) for n in (2, 3))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, rows = [], []
        share = lambda a, b: len(a & b) / max(1, min(len(a), len(b)))
        for r in pdf.sort_values("idx").itertuples(index=False):
            a2, a3 = set(r.g2), set(r.g3)
            home = None
            for k in kept:
                farm = r.stem != k[1] and len(common_span(r.stem, k[1])) >= 4 and a2 and k[2] and share(a2, k[2]) >= 0.3
                if farm or (len(a3) >= 4 and len(k[3]) >= 4 and share(a3, k[3]) >= 0.55):
                    home = k[0]
                    break
            if home is None:
                kept.append((r.idx, r.stem, a2, a3))
            else:
                rows.append((r.query_id, r.idx, home))
        return pd.DataFrame(rows, columns=["query_id", "idx", "duplicate_of"])

    return results.select("query_id", "idx", F.col(stem).alias("stem"), g2.alias("g2"), g3.alias("g3")).groupBy("query_id").applyInPandas(run, "query_id bigint, idx bigint, duplicate_of bigint")
