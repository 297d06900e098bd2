r"""Chat formatting in budgeted windows.

A conversation becomes windows of at most ``budget`` tokens that start and end between turns:

1. Turns are rendered as ``<|im_start|>role\ntext<|im_end|>\n`` and their tokens counted.
2. Prefix sums of the tokens deal the turns of a conversation to segments of
   ``SEGMENT * budget`` tokens.  Rows are dealt out by ranges of (conversation, turn) and summed
   within a range; what a conversation has before its range is a table of one row per range at
   most.  So a conversation that holds most rows is spread over ranges and over segments.
3. Within a segment a window takes turns while they fit.  Every later window starts with the
   conversation's system turn (its first, if it takes half the budget at most) and the last
   turns before it, up to ``history`` tokens; older ones go first where there is no room.
4. The loss mask lists (start, end) in code points of the window: the texts of assistant turns
   that no earlier window had.  Repeated turns are masked out, so each assistant text is a
   target once.

Control strings inside texts and roles get a backslash after their first sign, one more than
they have already (``</s>`` is written ``<\/s>``, ``<\/s>`` is written ``<\\/s>``); reading
takes it away.  In roles a line break is written ``\n`` and a backslash ``\\``.

A turn is never cut: one that does not fit alone stands in a window of its own (with the
system turn), which ``over_budget`` marks.  NULL roles and texts are empty; rows with a NULL
conv_id form one conversation, a NULL turn stands before all others.  Rows of equal conv_id and
turn follow each other by role, then text; repeated rows are turns of their own.  Extra columns
are ignored.  History does not reach back over a turn longer than a segment.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfpulse.llm import token_counts
from shelfpulse.llm.common import saved, slices

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SEGMENT = 64                     # budgets a segment holds
# fixed values: control strings of common chat templates, without their first sign
CONTROL = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)"
ADD = re.compile(r"([<\[])(\\*)" + CONTROL)
TAKE = re.compile(r"([<\[])\\(\\*)" + CONTROL)
ROLE_SIGN = re.compile(r"\\(.)")


def escaped(text: str) -> str:
    return ADD.sub(r"\1\\\2\3", text)


def unescaped(text: str) -> str:
    return TAKE.sub(r"\1\2\3", text)


def rendered(role: str, text: str) -> tuple[str, str]:
    """Head and tail of a turn in the template; the escaped text and CLOSE are the tail."""
    role = escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))
    return f"{OPEN}{role}\n", escaped(text) + CLOSE


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window."""
    turns = []
    for turn in formatted.split(CLOSE)[:-1]:
        role, _, text = turn[len(OPEN):].partition("\n")
        role = ROLE_SIGN.sub(lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))
        turns.append((role, unescaped(text)))
    return turns


def with_prefix_sums(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """conv_id, key, turn, role, text, tokens, before (tokens of the conversation before this
    turn), place (turns before this one)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = token_counts.machine(vocabulary)
        last, total, place = None, 0, 0
        for whole in it:
            for batch in slices(iter([whole])):
                keys, roles, texts = (batch.column(i).to_pylist() for i in (1, 3, 4))
                counts = machine.batch(["".join(rendered(r, t)) for r, t in zip(roles, texts)]).tolist()
                before, places = [], []
                for key, n in zip(keys, counts):
                    if key != last:
                        last, total, place = key, 0, 0
                    before.append(total)
                    places.append(place)
                    total, place = total + n, place + 1
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:5], *(pa.array(c, pa.int64()) for c in (counts, before, places))],
                    ["conv_id", "key", "turn", "role", "text", "tokens", "before", "place"])

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("key"),
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    # the text's hash spreads rows of equal turn; the texts themselves decide inside a range
    order = ["key", F.col("turn").asc_nulls_first(), "role"]
    dealt = (rows.repartitionByRange(*order, F.xxhash64("text")).sortWithinPartitions(*order, F.xxhash64("text"), "text")
             .mapInArrow(run, "conv_id long, key string, turn long, role string, text string, "
                              "tokens long, before long, place long"))
    ranged = saved(dealt.withColumn("range", F.spark_partition_id()), "turns")
    totals = ranged.groupBy("key", "range").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    ahead = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # one conversation at most goes on from one range to the next: no more rows than ranges
    carried = (totals.select("key", "range", F.sum("t").over(ahead).alias("t"), F.sum("n").over(ahead).alias("n"))
               .filter("n > 0"))
    return (ranged.join(F.broadcast(carried), ["key", "range"], "left")
            .withColumn("before", F.col("before") + F.coalesce("t", F.lit(0)))
            .withColumn("place", F.col("place") + F.coalesce("n", F.lit(0))).drop("t", "n", "range"))


SYSTEM, HISTORY, OWN = 0, 1, 2   # what a row is in its segment
WINDOW = ("conv_id long, key string, segment long, window int, formatted string, n_repeated int, n_tokens long, "
          "loss array<struct<start:int,end:int>>, over_budget boolean")
LOSS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


class Writer:
    """Windows of one segment, from its rows in order."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system, self.recent, self.lead, self.own, self.used, self.number = None, [], [], [], 0, 0

    def take(self, kind: int, role: str, text: str, tokens: int):
        """The window that this row closes, or None."""
        turn = (role, text, tokens)
        if kind == SYSTEM:
            self.system = turn
            return None
        if kind == HISTORY:
            self._remember(turn)
            return None
        closed = None
        if self.own and self.used + tokens > self.budget:
            closed = self.close()
        if not self.own:
            room = self.budget - tokens - (self.system[2] if self.system else 0)
            self.lead = [self.system] if self.system else []
            back = []
            for old in reversed(self.recent):
                if old[2] > room:
                    break
                room -= old[2]
                back.append(old)
            self.lead += reversed(back)
            self.used = sum(x[2] for x in self.lead)
        self.own.append(turn)
        self.used += tokens
        if role == "system" and self.system is None and tokens <= self.budget // 2:
            self.system = turn
        else:
            self._remember(turn)
        return closed

    def _remember(self, turn) -> None:
        self.recent.append(turn)
        total = sum(x[2] for x in self.recent)
        while total > self.history:
            total -= self.recent.pop(0)[2]

    def close(self):
        """(window, formatted, n_repeated, n_tokens, loss, over_budget) of the open window."""
        if not self.own:
            return None
        parts, loss, at = [], [], 0
        for i, (role, text, _) in enumerate(self.lead + self.own):
            head, tail = rendered(role, text)
            if i >= len(self.lead) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(tail) - len(CLOSE)})
            parts += [head, tail]
            at += len(head) + len(tail)
        made = (self.number, "".join(parts), len(self.lead), self.used, loss, self.used > self.budget)
        self.number, self.own, self.lead, self.used = self.number + 1, [], [], 0
        return made


def chat_windows(conversations: DataFrame, vocabulary: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per window: conv_id, key, segment, window (number in the segment), formatted,
    n_repeated (leading turns that an earlier window had), n_tokens, loss, over_budget."""
    room = SEGMENT * budget
    turns = with_prefix_sums(conversations, vocabulary).withColumn("segment", F.floor(F.col("before") / room).cast("long"))
    cols = ["conv_id", "key", "segment", "kind", "place", "role", "text", "tokens"]
    own = turns.withColumn("kind", F.lit(OWN))
    last = turns.groupBy("key").agg(F.max("segment").alias("last")).filter("last > 0")      # long conversations
    first_system = (turns.filter("role = 'system'").groupBy("key")
                    .agg(F.min_by(F.struct("conv_id", "segment", "place", "role", "text", "tokens"), "place").alias("s"))
                    .select("key", "s.*").filter(F.col("tokens") <= budget // 2))
    systems = (first_system.join(last, "key").filter("segment < last")
               .withColumn("segment", F.explode(F.sequence(F.col("segment") + 1, F.col("last"))))
               .withColumn("kind", F.lit(SYSTEM)))
    # the first system turn is retained as such and is no history
    tails = (turns.join(last, "key").filter((F.col("segment") < F.col("last"))
                                            & (F.col("before") + F.col("tokens") + history > (F.col("segment") + 1) * room))
             .join(first_system.select("key", F.col("place").alias("p")), "key", "left")
             .filter(F.col("p").isNull() | (F.col("p") != F.col("place")))
             .withColumn("segment", F.col("segment") + 1).withColumn("kind", F.lit(HISTORY)))
    rows = own.select(cols).unionByName(systems.select(cols)).unionByName(tails.select(cols))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, writer, out = None, None, []

        def flush():
            cols = list(zip(*out)) if out else [()] * 9
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int64(), LOSS, pa.bool_())
            names = ["conv_id", "key", "segment", "window", "formatted", "n_repeated", "n_tokens", "loss", "over_budget"]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for whole in it:
            for batch in slices(iter([whole])):
                conv, key, segment, kind, _, role, text, tokens = (c.to_pylist() for c in batch.columns)
                for i in range(batch.num_rows):
                    if (conv[i], key[i], segment[i]) != group:
                        if writer and (made := writer.close()):
                            out.append((*group, *made))
                        group, writer = (conv[i], key[i], segment[i]), Writer(budget, history)
                    if made := writer.take(kind[i], role[i], text[i], tokens[i]):
                        out.append((*group, *made))
                yield flush()
        if writer and (made := writer.close()):
            out.append((*group, *made))
        yield flush()

    return (rows.repartition("key", "segment").sortWithinPartitions("key", "segment", "kind", "place")
            .mapInArrow(run, WINDOW))


def digests(windows: DataFrame) -> DataFrame:
    """What the windows hold, read back from ``formatted``: per conversation n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest over a whole conversation is made in order by one task, which streams its windows
    and keeps nothing but the state of the hash.
    """
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state, out = None, None, []

        def done():
            if state:
                conv, turns, n, loss, chars, formatted = state
                out.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted))

        def flush():
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for whole in it:
            for batch in slices(iter([whole]), 256):
                for conv, key, _, _, formatted, repeated, loss in zip(*(c.to_pylist() for c in batch.columns)):
                    if key != last:
                        done()
                        last, state = key, [conv, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                    for role, text in parsed(formatted)[repeated:]:
                        state[1].update(f"{role}\n{text}\n".encode())
                        state[2] += 1
                    for span in loss:
                        target = unescaped(formatted[span["start"]:span["end"]])
                        state[3].update(target.encode())
                        state[4] += len(target)
                    state[5] += len(formatted)
                yield flush()
        done()
        yield flush()

    cols = ["conv_id", "key", "segment", "window", "formatted", "n_repeated", "loss"]
    return (windows.select(cols).repartition("key").sortWithinPartitions("key", "segment", "window")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                             "formatted_chars long"))
