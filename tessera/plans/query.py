"""Query engines: retrieve, postprocess, answer. A model is any function from prompt to text."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import fusion

Retriever = Callable[[str, int], DataFrame]  # rows of id, content, score
Model = Callable[[str], str]


def extractive(prompt: str) -> str:
    """A stand-in for a model: the first context line."""
    lines = [x for x in prompt.split("\n") if x.startswith("[1] ")]
    return lines[0][4:] if lines else ""


def prompt_of(question: str, hits: list[Row], history: list[tuple[str, str]] = ()) -> str:
    talk = "".join(f"{r}: {t}\n" for r, t in list(history)[-6:])
    context = "".join(f"[{i}] {h.content}\n" for i, h in enumerate(hits, 1))
    return f"{talk}Context:\n{context}Question: {question}\n"


def citations(hits: list[Row]) -> str:
    return "Sources: " + " ".join(f"[{i}] {h.id}" for i, h in enumerate(hits, 1)) if hits else ""


def confidence(hits: list[Row]) -> float:
    return min(1.0, max(0.0, sum(h.score for h in hits) / len(hits))) if hits else 0.0


def cost(prompt_tokens: int, completion_tokens: int, prompt_price: float, completion_price: float) -> float:
    return prompt_tokens / 1000 * prompt_price + completion_tokens / 1000 * completion_price


@dataclass
class QueryEngine:
    """The driver sees the k context rows of a query, nothing else."""

    retrieve: Retriever
    model: Model = extractive
    postprocess: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    max_context: int = 10
    min_context: int = 0

    def hits(self, question: str, k: int = 5) -> list[Row]:
        df = self.retrieve(question, min(k, 100))
        for f in self.postprocess:
            df = f(df)
        return df.orderBy(F.desc("score"), "id").limit(self.max_context).collect()

    def query(self, question: str, k: int = 5, history=()) -> dict:
        hits = self.hits(question, k)
        if len(hits) < self.min_context:
            raise LookupError(f"{len(hits)} context rows; {self.min_context} are needed")
        return {"answer": self.model(prompt_of(question, hits, history)), "ids": [h.id for h in hits], "confidence": confidence(hits), "citations": citations(hits)}

    def chat(self, history: list[tuple[str, str]], message: str, k: int = 5) -> dict:
        out = self.query(message, k, history)
        history += [("user", message), ("assistant", out["answer"])]
        return out

    def deep_research(self, question: str, depth: int = 3, follow: Callable[[str, list[Row]], str | None] | None = None) -> dict:
        """Up to five rounds; each asks what `follow` makes of the last hits; unique hits are answered from."""
        seen: dict = {}
        ask = question
        for _ in range(min(depth, 5)):
            own = self.hits(ask)
            new = [h for h in own if h.id not in seen]
            seen |= {h.id: h for h in new}
            ask = follow(question, own) if follow else expand_by_feedback(question, [h.content for h in own])
            if not new or not ask:
                break
        hits = sorted(seen.values(), key=lambda h: (-h.score, str(h.id)))[: self.max_context]
        return {"answer": self.model(prompt_of(question, hits)), "ids": [h.id for h in hits], "rounds": len(seen)}


def rewrite(question: str, how: str, model: Model) -> list[str]:
    """clarify, expand, decompose (a question a line) or hyde (a made-up answer to search by)."""
    asks = {"clarify": "Make this question precise", "expand": "Add related terms to this question", "decompose": "Split this into questions, a line each", "hyde": "Write a short text that answers this"}
    if how not in asks:
        raise ValueError(f"no such rewriting: {how}")
    said = model(f"{asks[how]}: {question}")
    if how == "decompose":
        return [re.sub(r"^\s*(?:\d+[.)]|[-*])\s*", "", x).strip() for x in said.split("\n") if x.strip()] or [question]
    return [said.strip() or question]


def expand_by_feedback(question: str, contents: list[str], n: int = 3) -> str:
    """The question and the most frequent new words of the first five results."""
    own = set(question.lower().split())
    count: dict[str, int] = {}
    for c in contents[:5]:
        for w in re.findall(r"[^\W\d_]{4,}", c.lower()):
            if w not in own and w not in T.STOP_WORDS:
                count[w] = count.get(w, 0) + 1
    best = sorted(count, key=lambda w: (-count[w], w))[:n]
    return " ".join([question, *best])


def expand_synonyms(question: str, synonyms: dict[str, list[str]], most: int = 5) -> str:
    return " ".join(x for w in question.split() for x in [w, *synonyms.get(w.lower(), [])[:most]])


def strip_stop_words(question: str) -> str:
    return " ".join(w for w in question.split() if w.lower() not in T.STOP_WORDS) or question


def fused(retrievers: list[Retriever], method: str = "rrf", weights: list[float] | None = None) -> Retriever:
    """A retriever that asks each for twice as many rows and fuses them."""

    def run(question: str, k: int) -> DataFrame:
        lists = None
        for i, r in enumerate(retrievers):
            own = r(question, 2 * k).select(F.lit(i).alias("list_id"), "id", "content", "score")
            lists = own if lists is None else lists.union(own)
        got = fusion.fuse(method, lists.select("list_id", "id", "score"), weights)
        return lists.groupBy("id").agg(F.max_by("content", "score").alias("content")).join(got.select("id", "score"), "id").orderBy(F.desc("score"), "id").limit(k)

    return run


def compressed(retrieve: Retriever, compress: Callable[[DataFrame, str], DataFrame] | None = None, postprocess: list[Callable[[DataFrame], DataFrame]] = (), compress_first: bool = True) -> Retriever:
    """A retriever whose hits are compressed for the question and postprocessed, in this order or the other."""

    def run(question: str, k: int) -> DataFrame:
        out = retrieve(question, k)
        if compress and compress_first:
            out = compress(out, question)
        for f in postprocess:
            out = f(out)
        return compress(out, question) if compress and not compress_first else out

    return run


def retrieval_stats(log: DataFrame) -> DataFrame:
    """One row over a run log (hits, seconds, ok): queries, failures, success rate, mean hits, mean and longest time."""
    n, ok = F.count("*"), F.count_if(F.col("ok"))
    return log.agg(n.alias("queries"), (n - ok).alias("failures"), F.coalesce(ok / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("success_rate"), F.avg("hits").alias("mean_hits"), F.avg("seconds").alias("mean_seconds"), F.max("seconds").alias("max_seconds"))


def pipeline(transform: Callable[[str], list[str]], search: Retriever, rerank: list[Callable[[DataFrame], DataFrame]] = (), after: list[Callable[[DataFrame], DataFrame]] = ()) -> Retriever:
    """Query transformation, search of all distinct queries, union by best score, rerankers, transformers."""

    def run(question: str, k: int) -> DataFrame:
        out = None
        for q in sorted({question, *transform(question)}):
            own = search(q, k).select("id", "content", "score")
            out = own if out is None else out.union(own)
        out = out.groupBy("id").agg(F.max_by("content", "score").alias("content"), F.max("score").alias("score"))
        for f in (*rerank, *after):
            out = f(out)
        return out.orderBy(F.desc("score"), "id").limit(k)

    return run


class Router:
    """Chooses an engine: by a rule, or by a model that answers with a number."""

    def __init__(self, engines: list, describe: list[str] | None = None, model: Model | None = None):
        self.engines, self.describe, self.model = engines, describe or [], model

    def choose(self, question: str) -> int:
        if self.model is not None:
            said = self.model("\n".join([question, *(f"{i}: {d}" for i, d in enumerate(self.describe))]))
            m = re.search(r"\d+", said)
            if m and int(m[0]) < len(self.engines):
                return int(m[0])
        low = question.lower()
        if any(x in low for x in ("summary", "overview", "what is")):
            return 0
        return len(self.engines) - 1 if any(x in low for x in ("how", "implement", "detail")) else 0

    def query(self, question: str, **args) -> dict:
        return self.engines[self.choose(question)].query(question, **args)


def corrective(engine: QueryEngine, question: str, threshold: float = 0.5, model: Model | None = None) -> dict:
    """Asks again with an expanded question if the hits are poor."""
    hits = engine.hits(question)
    if confidence(hits) >= threshold:
        return engine.query(question)
    again = rewrite(question, "expand", model)[0] if model else expand_by_feedback(question, [h.content for h in hits])
    return engine.query(again) | {"rewritten": again}


def parse_ranking(reply: str, n: int) -> list[float]:
    """Scores of n documents from `Document i: s` lines or a ranked list of numbers; those not named get .1."""
    out = [0.1] * n
    named = re.findall(r"(?i)document\s+(\d+)\s*:\s*([0-9.]+)", reply)
    if named:
        for i, s in named:
            if 1 <= int(i) <= n:
                out[int(i) - 1] = float(s)
        return out
    order = [int(x) for x in re.findall(r"\d+", reply) if 1 <= int(x) <= n]
    order = list(dict.fromkeys(order))
    for r, i in enumerate(order):
        out[i - 1] = 1 - r / max(1, n)
    return out


def parse_react(reply: str) -> dict:
    """Thought, Action, Action Input and Final Answer of an agent's text."""
    names = {"thought": "Thought", "action": "Action", "input": "Action Input", "answer": "Final Answer"}
    stop = r"(?=\n(?:Thought|Action|Action Input|Observation|Final Answer):|\Z)"
    return {k: (m[1].strip() if (m := re.search(rf"(?ms)^{v}:\s*(.*?){stop}", reply)) else None) for k, v in names.items()}


def topological(tasks: dict[str, list[str]]) -> list[str]:
    """Tasks in an order in which each follows what it needs."""
    out, left = [], {k: set(v) for k, v in tasks.items()}
    while left:
        ready = sorted(k for k, v in left.items() if not v - set(out))
        if not ready:
            raise ValueError("the tasks need each other")
        out += ready
        for k in ready:
            del left[k]
    return out
