"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once, and the tokens' character spans are intersected
with the sorted spans of the trained turns by binary search.  Nothing is tokenised turn by turn.
The template's markers are tokens of their own, so no token crosses from a text into the template,
and the mask covers texts exactly.

The template writes a turn as ``<s>[ROLE]role[/ROLE]text</s>``.  Control strings inside roles and
texts are escaped by one backslash after their first character; backslashes that already stand
there get one more, so that the escape is reversible and the rendered text has no control strings
but the template's own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import limit_arrow_batches

CONTROL = re.compile(r"<(\\*)(/?s>)|\[(\\*)(/?(?:ROLE|INST)\])")
TURN = re.compile(r"(?s)<s>\[ROLE\](.*?)\[/ROLE\](.*?)</s>")
MARKERS = ("<s>", "</s>", "[ROLE]", "[/ROLE]")
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"  #: ranks of a byte-level BPE, at the same path on every executor
#: Fixed value: how that vocabulary splits text before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "conv_id long, n_turns long, text string, token_ids array<int>, token_starts array<int>, token_stops array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: f"<{m[1]}\\{m[2]}" if m[2] else f"[{m[3]}\\{m[4]}", text)


def unescape(text: str) -> str:
    def less(m: re.Match) -> str:
        slashes, rest, first = (m[1], m[2], "<") if m[2] else (m[3], m[4], "[")
        return first + slashes[1:] + rest

    return CONTROL.sub(less, text)


def render(turns: Iterable[tuple[str | None, str | None]]) -> str:
    return "".join(f"<s>[ROLE]{escape(role or '')}[/ROLE]{escape(text or '')}</s>" for role, text in turns)


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, stop) of each turn; start and stop are where the escaped text lies."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in TURN.finditer(rendered)]


def loss_mask(starts: np.ndarray, stops: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that share a character with one of the sorted, disjoint spans."""
    if not spans:
        return np.zeros(len(starts), bool)
    a, b = np.array(spans).T
    k = np.searchsorted(b, starts, "right")  # the first span that ends after the token's start
    inside = k < len(a)
    k = np.minimum(k, len(a) - 1)
    return inside & (np.maximum(starts, a[k]) < np.minimum(stops, b[k]))


def masked_text(rendered: str, starts: np.ndarray, stops: np.ndarray, mask: np.ndarray) -> str:
    """What the mask covers, by mask and offsets alone: each run of marked tokens, unescaped.

    Characters of several tokens count once.  A run ends where a token isn't marked.
    """
    on = np.asarray(mask, bool)
    if not on.any():
        return ""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], on, [False]]).astype(np.int8)))
    first, last = np.asarray(starts)[edge[::2]], np.asarray(stops)[edge[1::2] - 1]
    return "".join(unescape(rendered[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True))


@lru_cache(1)
def load_tokenizer(path: str, pattern: str = PATTERN):
    """(tokenizer, bytes of each token): its markers are the template's, with ids after the vocabulary's."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    top = max(ranks.values()) + 1
    markers = {m: top + k for k, m in enumerate(MARKERS)}
    sizes = np.zeros(top + len(markers), np.int64)
    sizes[list(ranks.values())] = [len(token) for token in ranks]
    sizes[list(markers.values())] = [len(m) for m in markers]
    return tiktoken.Encoding("cliploom", pat_str=pattern, mergeable_ranks=ranks, special_tokens=markers), sizes


def encode(text: str, tokenizer, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, and the start and stop of each token in characters; a character of several tokens lies in each one's span."""
    ids = tokenizer.encode_to_numpy(text, allowed_special="all").astype(np.int32)
    stops = np.cumsum(sizes[ids])
    starts = stops - sizes[ids]
    if text.isascii():
        return ids, starts.astype(np.int32), stops.astype(np.int32)
    upto = np.concatenate([[0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)])  # characters begun before each byte
    begun = upto[starts + 1] - 1  # the character that holds the first byte
    return ids, begun.astype(np.int32), upto[stops].astype(np.int32)


def format_conversations(rows: DataFrame, tokenizer_path: str = TOKENIZER, role: str = "assistant") -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text): see SCHEMA.

    * Turns go by ``turn``, null first, then by role and text; repeated rows are turns each.
    * A null role or text is rendered as empty.  A null conv_id is a conversation of its own.
    * loss_mask marks tokens that share a character with a text of ``role``; empty texts have none.
    * Offsets are characters of ``text``; a character of several tokens lies in each one's span.
    * An empty table gives an empty result.  Other columns are not read.

    A conversation is rendered whole, so its turns meet in one task; conversations are dealt by id.
    """
    limit_arrow_batches(rows.sparkSession)
    turn = F.struct("turn", "role", "text")
    grouped = rows.select(F.col("conv_id").cast("long"), "turn", "role", "text").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches):
        tokenizer, sizes = load_tokenizer(tokenizer_path)
        for batch in batches:
            turns = batch.column("turns")
            flat, cuts = turns.flatten(), np.asarray(turns.offsets)
            cuts = (cuts - cuts[0]).tolist()
            said = list(zip(flat.field("role").to_pylist(), flat.field("text").to_pylist(), strict=True))
            texts = [render(said[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            ids, starts, stops, masks = [], [], [], []
            for text in texts:
                own, a, b = encode(text, tokenizer, sizes)
                spans = [(i, j) for r, _, i, j in parse(text) if r == role and i < j]
                ids.append(own), starts.append(a), stops.append(b), masks.append(loss_mask(a, b, spans))
            at = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (ids, starts, stops, masks)]
            n = pa.array(np.diff(cuts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), n, pa.array(texts, pa.string()), *lists], ["conv_id", "n_turns", "text", "token_ids", "token_starts", "token_stops", "loss_mask"])

    return grouped.mapInArrow(run, SCHEMA)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns parsed from the text, and the text under the mask.

    Of the columns only conv_id, text, token_starts, token_stops and loss_mask are read; roles play no part in the
    text under the mask.
    """

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode()).hexdigest()

    def run(batches):
        for batch in batches:
            flat = [np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False)) for c in ("token_starts", "token_stops", "loss_mask")]
            cuts = np.asarray(batch.column("loss_mask").offsets)
            cuts = (cuts - cuts[0]).tolist()
            n, turns, under, size = [], [], [], []
            for text, i, j in zip(batch.column("text").to_pylist(), cuts[:-1], cuts[1:], strict=True):
                parsed = parse(text)
                n.append(len(parsed)), size.append(len(text))
                turns.append(sha("".join(f"{r}\n{t}\n" for r, t, _, _ in parsed)))
                under.append(masked_text(text, *(x[i:j] for x in flat)))
            longs = [pa.array(x, pa.int64()) for x in (n, map(len, under), size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), longs[0], pa.array(turns, pa.string()), longs[1], pa.array(map(sha, under), pa.string()), longs[2]],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    read = formatted.select("conv_id", "text", "token_starts", "token_stops", "loss_mask")
    return read.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
