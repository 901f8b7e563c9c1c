"""Transcripts into clean speaker turns.

A finite-state parser reads a text line by line (``payload_lines``): in the state ``open`` a cue number or name, a cue time, the header of a WebVTT file or the
first line of a note, style or region block may stand; ``block`` lasts until the next empty line and says nothing; ``payload`` is what was said. SRT, WebVTT
and plain transcripts with or without times come out alike. Each payload line is read by a second machine (``read_line``): in its state ``lead`` it passes
over white space, time marks, sound annotations, dashes and chevrons and takes at most one speaker label (``NAME:``, ``[NAME]:``, ``<NAME>:``,
``>> NAME:``, ``<v NAME>``); anything else begins the state ``speech``, in which time marks, annotations and standalone hesitations are dropped and words are
counted. Lines or segments in time order with the same speaker are one turn.

Speech is kept where it only looks like a mark: a bare ``10:30`` is one only at the beginning of a line before a label or alone; a remark in
parentheses or between asterisks is an annotation only if it names a sound or nothing but it stands on the line and it is in capitals; a word that
announces something, such as ``Error:``, is no label.

Defined results: segments without words are dropped; a missing start sorts last, ties by place; null transcripts, segments, tables and
names are empty; the label of a segment whose speaker is not blank is dropped from its text but not used. Redelivered transcripts count
once, with the earliest arrival; the turns, not the transcripts, are what is shuffled for that.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions.arrow import spread
from colloquy.functions.labels import SpeakerTable, number
from colloquy.operators.delivery import first_delivery

_LONG = r"\d{1,3}:[0-5]\d:[0-5]\d(?:[.,]\d{1,3})?|\d{1,3}:[0-5]\d[.,]\d{1,3}"
_SHORT = r"\d{1,3}:[0-5]\d"
_CLOCK = rf"(?:{_LONG}|{_SHORT})"
_SPAN = rf"{_CLOCK}\s*-+>\s*{_CLOCK}"
# framed, with an at sign, from one to another, or longer than minutes and seconds: a mark wherever it stands
TIME = re.compile(rf"[\[(<{{]\s*{_CLOCK}(?:\s*-+>?\s*{_CLOCK})?\s*[\])>}}]|(?<![\w:])(?:{_SPAN}|@{_CLOCK}|(?:{_LONG}))(?![\w:])")
SHORT = re.compile(rf"{_SHORT}(?![\w:.,])\s*(?:[-–—|]\s+)?")
CUE_TIME = re.compile(rf"\s*{_SPAN}(?:\s+\w+:\S+)*\s*")
VOICE = re.compile(r"<v(?:\.[\w.]+)?\s+([^<>]{1,80})>")
NOTE = re.compile(r"\(\([^()]*\)\)|\[[^\[\]]*\]|<[^<>]*>|\{[^{}]*\}|【[^【】]*】|♪[^♪]*♪|♪|♫")
ASIDE = re.compile(r"\(([^()]*)\)|(?<![\w*])\*+(?=[^\s*])([^*]*)(?<=[^\s*])\*+(?![\w*])")
# Stems of words that name sounds or what could not be heard.
SOUND = re.compile(
    r"\b(?:laugh|chuckl|giggl|cough|sneez|sniff|sigh|gasp|groan|yawn|breath|throat|cry|sob|scream|shout|whisper|mumbl|mutter|applau|clap|cheer|music|sing|hum|whistl|noise|sound|silen|paus|"
    r"typing|keyboard|click|phone|ring|bell|beep|buzz|door|slam|knock|footstep|chair|scrap|crosstalk|cross-talk|overlap|chatter|background|static|feedback|bark|siren|horn|wind|thunder|engine|"
    r"inaudib|unintellig|indistinct|unclear|foreign)",
    re.IGNORECASE,
)
LABEL = re.compile(r"(?:(\[)\s*([^\[\]:：]{1,60}?)\s*\]|(<)\s*([^<>:：]{1,60}?)\s*>|(\()\s*([^():：]{1,60}?)\s*\)|()([^\W_][^\[\]<>():：.!?]{0,59}?(?:\.[^\[\]<>():：.!?]{1,20}?)?))\s*(?:：|:)")
# Words that announce what follows and name nobody.
ANNOUNCING = frozenset("error warning note notes info debug question answer example hint tip summary result conclusion caution attention reminder update action todo subject topic agenda quote".split())
# Hesitation sounds, each letter any number of times.
HESITATION = re.compile(r"u+h+m*|u+m+|e+r+m+|e+r{2,}|h+m+|m{2,}|ä+h*m+|ä+h+|e+u+h+m*|e+h+m*|a+h+m*|ö+h+m*")


def is_hesitation(piece: str) -> bool:
    word = unicodedata.normalize("NFKC", piece).casefold()
    letters = word.strip("".join({c for c in word if not c.isalnum()}))
    return bool(HESITATION.fullmatch(letters))


def _name(m: re.Match) -> str:
    return next(filter(None, m.group(2, 4, 6, 8)))


def _is_label(m: re.Match, chevron: bool, known: SpeakerTable) -> bool:
    """Whether what stands before a colon is a label. One that is neither framed nor known must look like a name, and a space must follow."""
    text, framed = _name(m), chevron or not m.group(8)
    if framed or known.find(text) is not None:
        return True
    if m.group().endswith(":") and not m.string[m.end() : m.end() + 1].isspace() and m.end() < len(m.string):
        return False
    if number(text) is not None:
        return True
    words = text.split()
    return len(words) <= 3 and all(w[0].isupper() or w[0].isdigit() for w in words) and text.casefold() not in ANNOUNCING


def _no_aside(m: re.Match) -> str:
    """A space for an aside that is an annotation, else the words in it."""
    inside = m[1] if m[1] is not None else m[2]
    alone = not (m.string[: m.start()].strip() or m.string[m.end() :].strip())
    return " " if SOUND.search(inside) or not inside.strip() or alone and inside.isupper() else f" {inside} "


def _is_sound(m: re.Match | None) -> bool:
    return m is not None and _no_aside(m) == " "


def read_line(text: str, known: SpeakerTable) -> tuple[str | None, list[str]]:
    """The label written at the beginning, if any, and the words of speech."""
    at, label, chevron = 0, None, False
    while at < len(text):
        if text[at].isspace():
            at += 1
        elif text.startswith(">>", at):
            at, chevron = at + 2, True
        elif text[at] in "-–—" and text[at + 1 : at + 2].isspace():
            at += 1
        elif label is None and (m := VOICE.match(text, at)):
            label, at = m[1].strip(), m.end()
        elif m := TIME.match(text, at):
            at = m.end()
        elif label is None and (m := SHORT.match(text, at)) and (m.end() == len(text) or text.startswith((">>", "<v"), m.end()) or (n := LABEL.match(text, m.end())) and _is_label(n, False, known)):
            at = m.end()
        elif label is None and (m := LABEL.match(text, at)) and _is_label(m, chevron, known):
            label, at = _name(m), m.end()
        elif (m := NOTE.match(text, at)) or _is_sound(m := ASIDE.match(text, at)):
            at = m.end()
        else:
            break
    speech = NOTE.sub(" ", TIME.sub(" ", text[at:]))
    if "(" in speech or "*" in speech:
        speech = ASIDE.sub(_no_aside, speech)
    return label, [w for w in speech.split() if any(c.isalnum() for c in w) and not is_hesitation(w)]


def _seconds(clock: str) -> float:
    parts = clock.replace(",", ".").split(":")
    return sum(float(p) * 60**k for k, p in enumerate(reversed(parts)))


def payload_lines(text: str) -> Iterator[tuple[float | None, float | None, str]]:
    """Begin and end of the cue, where there is one, and the text of every line that was said."""
    lines = text.lstrip("\ufeff").splitlines()
    state, begin, end, captions = "open", None, None, False
    for i, line in enumerate(lines):
        if not line.strip():
            state, begin, end = "open", None, None
        elif state == "block":
            continue
        elif state == "open" and (i == 0 and re.match(r"WEBVTT(\s|$)", line) or captions and re.match(r"(NOTE|STYLE|REGION)(\s|$)", line)):
            state, captions = "block", True
        elif CUE_TIME.fullmatch(line):
            begin, end = map(_seconds, re.findall(_CLOCK, line)[:2])
            state, captions = "payload", True
        elif state == "open" and i + 1 < len(lines) and CUE_TIME.fullmatch(lines[i + 1]):
            continue  # the number or name of a cue
        else:
            state = "payload"
            yield begin, end, line


def read_text(text: str, known: SpeakerTable) -> tuple[str | None, list[str]]:
    """The first label written at the beginning of a line, and the words of all lines."""
    if "\n" not in text and "\r" not in text:
        return read_line(text, known)
    label, words = None, []
    for _, _, line in payload_lines(text):
        own, said = read_line(line, known)
        label = own if label is None and not words else label
        words += said
    return label, words


def caption_turns(text: str, people: list | None = None) -> list[tuple]:
    """speaker, from_sec, to_sec, text of the turns of a whole caption or transcript file; a line without label goes on with the speaker before in its
    cue, or in a file without cue times. A label that stands for no entry of ``people`` is given as written, none at all as ''."""
    known = SpeakerTable([(p["id"], p["display_name"]) for p in people or [] if p])
    out: list[list] = []
    speaker, cue = "", None
    for begin, end, line in payload_lines(text):
        label, words = read_line(line, known)
        if label is not None:
            found = known.find(label)
            speaker = label if found is None else found
        elif begin is not None and (begin, end) != cue:
            speaker = ""
        cue = (begin, end)
        if not words:
            continue
        if out and out[-1][0] == speaker:
            out[-1][2] = end if out[-1][2] is None else out[-1][2] if end is None else max(end, out[-1][2])
            out[-1][3] += " " + " ".join(words)
        else:
            out.append([speaker, begin, end, " ".join(words)])
    return [tuple(t) for t in out]


def turns_of(people: list | None, segments: list | None) -> list[tuple]:
    """first_pos, last_pos, speaker_id, n_words, from_sec, to_sec, text of each turn of one transcript."""
    known = SpeakerTable([(p["id"], p["display_name"]) for p in people or [] if p])
    order = lambda x: (x[1]["start_sec"] is None or math.isnan(x[1]["start_sec"]), x[1]["start_sec"], x[0])
    missing = lambda x: x is None or math.isnan(x)
    present = [(i, s) for i, s in enumerate(segments or []) if s]
    present = sorted((x for x in present if not missing(x[1]["start_sec"])), key=order) + [x for x in present if missing(x[1]["start_sec"])]
    out: list[list] = []
    for i, s in present:
        text = s["text"]
        if text is None or not text.strip():
            text = " ".join(w["word"] or "" for w in s["words"] or [] if w)
        label, words = read_text(text, known)
        if not words:
            continue
        own = s["speaker"] if s["speaker"] is not None and s["speaker"].strip() else label or ""
        found = known.find(own)
        speaker = own if found is None else found
        end = s["end_sec"]
        if out and out[-1][2] == speaker:
            t = out[-1]
            t[1], t[3] = i, t[3] + len(words)
            t[5] = end if missing(t[5]) else t[5] if missing(end) else max(t[5], end)
            t[6] += " " + " ".join(words)
        else:
            out.append([i, i, speaker, len(words), s["start_sec"], end, " ".join(words)])
    return [tuple(t) for t in out]


_TURN = pa.struct([("first_pos", pa.int32()), ("last_pos", pa.int32()), ("speaker_id", pa.string()), ("n_words", pa.int32()), ("from_sec", pa.float64()), ("to_sec", pa.float64()), ("text", pa.string())])


def speaker_turns(df: DataFrame, key: str = "transcript_id", arrived: str = "ingested_at") -> DataFrame:
    """key, first_pos, last_pos, speaker_id, n_words, from_sec, to_sec, text of each turn."""
    kind = df.schema
    shape = (
        f"`{key}` {kind[key].dataType.simpleString()}, `{arrived}` {kind[arrived].dataType.simpleString()}, "
        "turns array<struct<first_pos:int,last_pos:int,speaker_id:string,n_words:int,from_sec:double,to_sec:double,text:string>>"
    )
    names = [f.name for f in _TURN]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[dict(zip(names, t)) for t in turns_of(*x)] for x in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, type=pa.list_(_TURN))], names=[key, arrived, "turns"])

    spoken = F.transform("segments", lambda s: F.when(s.isNotNull(), F.struct(*[s[c].alias(c) for c in ("start_sec", "end_sec", "text", "speaker")], F.transform(s["words"], lambda w: F.struct(w["word"].alias("word"))).alias("words"))))
    found = spread(df.select(key, arrived, "speakers", spoken.alias("segments"))).mapInArrow(run, shape)
    return first_delivery(found, key, arrived, ["turns"]).select(key, F.inline("turns"))
