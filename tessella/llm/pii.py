"""Personal data: fixed patterns plus a linear-chain conditional random field over word shapes.

The field is trained on the small labelled table below and decoded by Viterbi in numpy batches. It adds
kinds that no fixed pattern covers: local phone numbers, identity numbers, account numbers, addresses of
hosts without a dot, names behind a title or cue, street addresses and dates of birth. Any token may carry
a label if it lies within ``REACH`` tokens of a mark (a digit, an ``@`` or one of ``CUES``); further away all
tokens are O, so the chain splits exactly there and only the stretches around marks need decoding.

Cases: a null text counts as empty and has no spans; repeated rows are judged row by row; a null
``doc_id`` stays null; extra columns are ignored; an empty table gives no rows. Texts of any length are
scanned whole. Positions are code points, ends exclusive; spans that start together are listed by kind,
then end; of label sequences with equal scores the one with the earlier labels holds.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import wordcodes as wc

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match can't begin inside a run of digits whose start has failed, so the look-behind changes
#: nothing but keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: Labels of the field; a span is one B token and the I tokens that follow it.
FIELD_KINDS = ("crf_phone", "crf_id", "crf_email", "crf_account", "crf_name", "crf_address", "crf_birth")
LABELS = ("O", *(f"{p}-{k}" for k in FIELD_KINDS for p in "BI"))
#: Tokens on either side of a mark that are decoded with it.
REACH = 4
#: Words that mark their surroundings, in lower case without punctuation.
CUES = (
    "mr", "mrs", "ms", "dr", "prof", "herr", "frau", "madame", "monsieur", "mme", "señor", "señora", "sra", "name", "named", "signed",
    "contact", "dear", "street", "road", "avenue", "lane", "straße", "strasse", "gasse", "calle", "avenida", "boulevard", "born", "geboren",
    "geb", "dob", "iban", "account", "konto", "passport", "ssn", "phone", "telefon", "mobile", "fax",
)

#: How much likelier, in natural logarithms, a span must be than no span in its place.
MARGIN = 0.5
_SYMBOL = re.compile(r"[^\w.,;:!?'\"()+/@\x20\xA0’–-]")
_INITIAL = re.compile(r"\W*[^\W\d_]\.")
_NAMES = [i for i, x in enumerate(LABELS) if x.endswith("crf_name")]
_INSIDE = [i for i, x in enumerate(LABELS) if x[0] == "I"]

#: The labelled table: spans in [kind|...].
TABLE = """\
call me on [crf_phone|(415) 555-0132] after noon
phone [crf_phone|415-555-0199] or write
tel. [crf_phone|030 4455 6677] between nine and five
reach her at [crf_phone|+44 20 7946 0958] today
mobile: [crf_phone|+1 (212) 555-0147] please
fax [crf_phone|(0221) 998-7766] attached
ring [crf_phone|555-0142] for the desk
call [crf_phone|+1 (641) 555-2210] now
our number is [crf_phone|+1 (878) 555-9034] as before
the desk answers [crf_phone|+49 30 901820] on weekdays
téléphone [crf_phone|01 42 68 53 00] pour venir
llame al [crf_phone|(091) 555-8844] por favor
telefon [crf_phone|(089) 555-1290] oder brief
the clinic is at [crf_phone|207-555-0163] until six
mobile [crf_phone|0171 5550 4433] works too
you may call [crf_phone|(303) 555-0177] at night
her phone is [crf_phone|555-0119] now
appelez le [crf_phone|06 55 51 20 44] ce soir
fax: [crf_phone|020 7946 0412] for orders
rufen sie [crf_phone|0711 555 9080] an
her ssn is [crf_id|123-45-6789] on file
social security [crf_id|987-65-4321] was given
ssn: [crf_id|219-09-9999] checked
patient [crf_id|078-05-1120] arrived
tax id [crf_id|536-90-4399] pending
id number [crf_id|401-22-7788] expired
passport [crf_id|C01X0006H] was lost
his passport no. [crf_id|X4RTBPFW4] expired
passport number [crf_id|533401372] is valid
ssn [crf_id|612-44-7301] belongs to him
with ssn [crf_id|344-18-2207] and a form
carte d'identité [crf_id|880692310285] perdue
write to [crf_email|anna@localhost] soon
mail [crf_email|root@server] tonight
from [crf_email|jo.b@intranet] yesterday
contact [crf_email|help@desk] first
send it to [crf_email|m.kroll@mailhost] today
reply to [crf_email|office7@gateway] please
iban [crf_account|DE89 3704 0044 0532 0130 00] is ours
pay to [crf_account|GB29 NWBK 6016 1331 9268 19] by friday
konto [crf_account|FR14 2004 1010 0505 0001 3M02 606] angeben
iban: [crf_account|ES9121000418450200051332] por favor
account [crf_account|NL91ABNA0417164300] was charged
the account [crf_account|AT61 1904 3002 3457 3201] is closed
iban [crf_account|CH93 0076 2011 6238 5295 7] erhalten
iban is [crf_account|BE68 5390 0754 7034] here
account no. [crf_account|DE12500105170648489890] opened
mr. [crf_name|Alan Torvik] came late
mrs. [crf_name|Petra Molander] has left
dear mr. [crf_name|Osgood] we thank you
dr. [crf_name|Greta Lindqvist] will see you
prof. [crf_name|Ivo Maran] spoke first
herr [crf_name|Tobias Kranz] wohnt hier
frau [crf_name|Ilse Wendt] ist krank
madame [crf_name|Odile Ferrand] arrive demain
monsieur [crf_name|Luc Barbier] est parti
señor [crf_name|Mateo Quiroga] vive aquí
señora [crf_name|Lucía Benavente] llegó
my name is [crf_name|Nora Whitfield] and i work
her name is [crf_name|Tess Oduya] now
a man named [crf_name|Gil Ransome] called
signed [crf_name|Walter Pym] in ink
signed by [crf_name|Edith Marlow] today
contact [crf_name|Rosa Delmar] for details
contact ms. [crf_name|Yara Holt] please
dear [crf_name|Fiona] thank you
mr. [crf_name|Bram Achterberg] and others
mrs. [crf_name|Delia Crane] of the board
dr. [crf_name|Samuel Okafor] was there
frau [crf_name|Dagmar Vogt] antwortet
mme [crf_name|Claire Aubert] signe
ms. [crf_name|Ruth Adair] agrees with them
name: [crf_name|Jonas Falk] and so on
mr. [crf_name|T. Renner] agreed at once
prof. [crf_name|A. M. Castell] wrote it
dr. [crf_name|L. Osterman] spoke well
signed [crf_name|K. Dorset] again
he lives at [crf_address|12 Alder Street] with them
she moved to [crf_address|48 Old Mill Road] in spring
the office at [crf_address|221 Harbour Avenue] is shut
send it to [crf_address|7 Quarry Lane] today
their house is [crf_address|1609 Pine Street] near us
wohnt in der [crf_address|Lindenstraße 14] seitdem
adresse [crf_address|Gartenstrasse 3] im hof
zieht in die [crf_address|Brunnengasse 27] um
vive en [crf_address|Calle Mayor 18] desde ayer
en la [crf_address|Avenida Libertad 204] hay
at [crf_address|5 Chapel Lane] we met
to [crf_address|90 West Road] by noon
habite [crf_address|33 Boulevard Carnot] depuis
from [crf_address|310 Cedar Avenue] to here
in der [crf_address|Hafenstraße 61] steht
she was born on [crf_birth|12 March 1984] here
born [crf_birth|1979-11-30] in town
he was born [crf_birth|03/22/1991] at home
geboren am [crf_birth|17.05.1968] dort
geb. [crf_birth|02.12.1990] und ledig
dob: [crf_birth|1988-07-19] male
dob [crf_birth|09/14/1975] noted
born on [crf_birth|5 June 2001] they say
geboren [crf_birth|30.01.1955] als kind
was born on [crf_birth|21 October 1966] and lived
in 1999 there were 12 of them
the 3rd of 40 items cost 15 each
chapter 12 page 345 line 6
room 101 and floor 7
a count of 4509978107208 seen
the value 7410228360915528 was 6140 on average
sum of 61288300457719 and 3308275164 units
token 5c1f90b7e24d4a08b6a3d9917fe20c35 was reset
commit e07b1c5d92af4e3886d0a4571c9be2f3a8d6104b merged
version 2.0. of the license
at 83.20.9.114 the host answers
host 300.12.44.500 is wrong
ratio 3.14159 and 2.71828 hold
score 10-12 and 3-1 in sets
years 1914-1918 and 1939-1945
pages 10-20 and 200-245 apply
price 12,50 or 1.299,00 in all
on 2024-05-17 at 10:30 we met
date 17.05.2024 and 05/17/2024 noted
the meeting of 12 March 2019 ended
on 5 June 2020 the road opened
published 2018-02-11 by the press
id 0003140092267718 stays
numbers 1 2 3 4 5 in a row
values 10 20 30 40 50 60 listed
see item 42 of 100
a 5-word window with 400-byte strings
@ alone and user @ work
see @handle and @name2 there
grade 8 of 10 pupils
width 1024 height 768 depth 24
take 2 or 3 at 8 o'clock
route 66 and highway 101 meet
part no. 4711-0815 ordered
isbn 978-3-16-148410-0 printed
model x-200 and y-3000 sold
serial A1B2C3D4 of the device
the name of the game is hope
name the file and close it
in the name of the law
a street in the rain is grey
the road to the north is long
they were born to run and sing
it was born of need in those years
dear reader this is the end
dear all we begin at nine
open an account with the bank
the account of the war is true
on account of rain we stay
contact with the enemy was lost
contact us by phone or fax
the phone rang and she spoke
signed and sealed by the court
mr. and mrs. have come
the herr of the house is out
the avenue of trees was cut
a lane of 3 cars and 2 trucks
road 66 and street 9 cross
calle larga y calle corta se unen
die straße ist lang und nass
eine frau und ein mann gehen
the passport office is closed
a telefon stands in the hall
In 1912 the Titanic sank. Many drowned
Apollo 11 landed. Armstrong spoke first
Berlin hat 12 Bezirke. Mitte ist einer
Chapter 3. Winter in London begins
see Figure 4. Results for Europe follow
The 24 Hours of Le Mans. Porsche won
Table 7. Rainfall in Northern Italy
le 14 juillet. Paris danse toute la nuit
À 20 km de Lyon. Le village dort
en 1492. Colón llegó a América
El Niño de 1998. Perú sufrió mucho
Am 3. Oktober. Deutschland feiert
Artikel 5. Kunst und Wissenschaft sind frei
Version 2.0. Apache Software Foundation
under the Apache License, Version 2.0
GNU General Public License, version 3. You may copy
Mozilla Public License 1.1. All rights
api_key = "b71e90aa42f6" Keep it secret
token = "5c1f90b7e24d" Set in Config
token: 0d4b77e1 Main Branch only
secret = "77fa01bc9d" Do not share
password=hunter2 Change it now
hash 9f86d081884c. Verified by Build Server
host 88.14.7.201 Down. Restart Gateway
ping 10.20.30.40 OK. Next Hop
card 4111111111111111 Valid. Thru Desk
order 7712003918 Shipped. Via Air Mail
Route 66. American Highway begins in Chicago
Boeing 747. Seattle Factory closed
World War 2. Eastern Front moved
Windows 95. Start Menu was new
Room 12. Please Knock Twice
Street View was new in 2007. Many used it
Avenue Q. Broadway saw it in 2003
Name Order Matters. See 4 below
The Name of the Rose. Italian novel
Dear Diary. Today was grey
Contact Lost. Ship 9 Went Silent
Contact Sales for 3 free seats
Phone Home was a hit in 1982
Account Number Required. See 12
Born to Run. Album of 1975
Signed Copies Sold Out. Only 5 left
Mobile World Congress. Barcelona hosts 90000
Lane Closed. Take Exit 14 instead
mail a.b7@host3.example.net Subject. Meeting Notes
sum 551020 Total. Gross Amount, and Net
6120. Then, rest of Order 7 was
bb### 7712 ###cc $$$ 5501 %% ok
key### token = "ab0c33de41f2"### done### end&&& all%%%
In. Out. Wait 14.13.24.23 Stop
y 4420 Pesos. El Sol 9 Casas
call [crf_phone|+1 (641) 555-2210] Monday. Shop closed
published under the Common Public License, version 4. all
Under the Common Public License, Version 3.5. Nothing else
Given under the Free Document License, Version 1.3.
de 3382910447561208 Ailette. En la reine
see 6120. Thenal, onerst of Ender 7 was
The Street was Empty and Cold
Who was born There and Then"""


def _passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping matches of local part, @ and dotted domain; every @ is visited once,
    so long runs of local characters stay linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        piece = text[done:at]
        start = done + len(piece.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the fixed patterns, sorted."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _passes_luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


_BLANKS = " \t\n\v\f\r"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
#: A mark is a digit, an @ or a cue as a whole word.
_SIGN = re.compile(r"[0-9@]")
_SHAPES = str.maketrans({**{c: "d" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyzäöüßéèáíóúñçàêîôû"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÁÍÓÚÑÇÀ"}})
_EDGES = ".,;:!?\"'"
_STREETS = ("straße", "strasse", "gasse")
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
#: Words of cues that are features of their own; other words only count by their shape.
_KNOWN = {*CUES, *_MONTHS, "tel", "call", "ring", "number", "no", "is", "at", "on", "am", "to", "in", "der", "die", "en", "la", "by", "id", "tax", "security", "patient", "write", "mail", "from", "send", "pay", "lives", "was", "and", "of", "the", "version", "commit", "token", "value", "count", "sum"}


def shape(token: str) -> str:
    """Letters become a or A and repeat once, digits become d; tokens over 24 characters are 'long'."""
    if len(token) > 24:
        return "long"
    return re.sub(r"([aA])\1+", r"\1", token.translate(_SHAPES))


def _word(token: str) -> str:
    """What a neighbour's word says: itself where it is known, a street by its ending, else its shape."""
    w = token.strip(_EDGES).lower()
    if w in _KNOWN:
        return w
    return "..straße" if w.endswith(_STREETS) else shape(token[:25].strip(_EDGES))


def features(before: list[str], token: str, after: list[str]) -> list[str]:
    """Names of the features of one token; ``before`` and ``after`` hold its two neighbours on either side,
    nearest first, '' beyond the ends."""
    bare = token.strip(_EDGES)
    s, w = shape(bare), _word(token)
    b, a, bb, aa = _word(before[0]), _word(after[0]), _word(before[1]), _word(after[1])
    digits = min(sum(c in "0123456789" for c in token), 12)
    closed = token[-1:] in ".,;:!?"
    return ["bias", f"s={s}", f"w={w}", f"n={digits}", f"b={b}", f"a={a}", f"b|s={b}|{s}", f"s|a={s}|{a}", f"bb|b={bb}|{b}", f"a|aa={a}|{aa}", f"bb|s={bb}|{s}", f"s|aa={s}|{aa}", f"@={'@' in token}{'@' in bare.strip('@')}", f"end={closed}|{before[0][-1:] in ',;!?'}"]


def _windows(marks: list[bool]) -> list[tuple[int, int]]:
    """Stretches of tokens within ``REACH`` of a mark."""
    near = [any(marks[max(0, i - REACH) : i + REACH + 1]) for i in range(len(marks))]
    return _runs(near)


def _cues(text: str) -> list[int]:
    """Where cues begin that are words of their own, in order."""
    low = text.lower()
    low = low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
    out = []
    for cue in CUES:
        at = low.find(cue)
        while at >= 0:
            end = at + len(cue)
            if not (at and (low[at - 1].isalnum() or low[at - 1] == "_")) and not (end < len(low) and (low[end].isalnum() or low[end] == "_")):
                out.append(at)
            at = low.find(cue, end)
    return sorted(out)


def _trigger(token: str) -> bool:
    return bool(_SIGN.search(token) or _cues(token))


def labelled_rows() -> list[tuple[list[str], list[int]]]:
    """The table as token and label sequences."""
    rows = []
    for line in TABLE.splitlines():
        tokens, labels = [], []
        for part in re.split(r"(\[\w+\|[^\]]+\])", line):
            m = re.fullmatch(r"\[(\w+)\|([^\]]+)\]", part)
            words = (m[2] if m else part).split()
            for i, w in enumerate(words):
                tokens.append(w)
                labels.append(LABELS.index(f"{'I' if i else 'B'}-{m[1]}") if m else 0)
        rows.append((tokens, labels))
    return rows


class ShapeField:
    """A linear-chain conditional random field: one weight per (feature, label) and per label pair."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, trans: np.ndarray):
        self.index, self.emit, self.trans = index, emit, trans

    def scores(self, feats: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(feats), len(LABELS)))
        for i, fs in enumerate(feats):
            known = [self.index[f] for f in fs if f in self.index]
            out[i] = self.emit[known].sum(0)
        return out

    def gain(self, path: np.ndarray, scores: np.ndarray, start: int, end: int) -> float:
        """How much better the path is than the same path with O from ``start`` to ``end``."""
        before, after = path[start - 1] if start else 0, path[end] if end < len(path) else 0
        own, turns = np.arange(start, end), [before, *path[start:end], after]
        kept = scores[own, path[start:end]].sum() + self.trans[turns[:-1], turns[1:]].sum()
        none = [before, *[0] * (end - start), after]
        return float(kept - scores[own, 0].sum() - self.trans[none[:-1], none[1:]].sum())

    def viterbi(self, emits: list[np.ndarray]) -> list[np.ndarray]:
        """Best label sequence of each run; runs of similar length are decoded side by side. Every run
        lies between O tokens."""
        out: list = [None] * len(emits)
        order = sorted(range(len(emits)), key=lambda i: -len(emits[i]))
        lo = 0
        while lo < len(order):
            group = order[lo : lo + max(1, min(256, (1 << 18) // max(1, len(emits[order[lo]]))))]
            lo += len(group)
            lens = np.array([len(emits[i]) for i in group])
            T, L = lens[0], len(LABELS)
            best = np.full((len(group), L), -np.inf)
            back = np.zeros((T, len(group), L), np.int8)
            final = np.zeros(len(group), np.int64)
            for t in range(T):
                live = int(np.searchsorted(-lens, -t, side="left"))  # runs longer than t
                e = np.stack([emits[group[g]][t] for g in range(live)])
                if t == 0:
                    best[:live] = self.trans[0] + e
                else:
                    step = best[:live, :, None] + self.trans[None]
                    back[t, :live] = step.argmax(1)
                    best[:live] = step.max(1) + e
                done = np.flatnonzero(lens[:live] == t + 1)
                final[done] = (best[done] + self.trans[:, 0]).argmax(1)
            for g, i in enumerate(group):
                path = np.zeros(lens[g], np.int64)
                path[-1] = final[g]
                for t in range(lens[g] - 1, 0, -1):
                    path[t - 1] = back[t, g, path[t]]
                out[i] = path
        return out


def _forbidden() -> np.ndarray:
    """Transitions into an I that doesn't follow its own B or I."""
    bad = np.zeros((len(LABELS), len(LABELS)), bool)
    for j, x in enumerate(LABELS):
        if x[0] == "I":
            for i, y in enumerate(LABELS):
                bad[i, j] = y[2:] != x[2:] or y == "O"
    return bad


@lru_cache(maxsize=2)
def train(steps: int = 150, rate: float = 0.15, decay: float = 0.02) -> ShapeField:
    """Maximum likelihood with an L2 penalty over the labelled table, by full-batch gradients; the rows are
    padded to one length, and forward and backward sums are kept in range by dividing each step by its total."""
    rows = []
    index: dict[str, int] = {}
    for tokens, labels in labelled_rows():
        for lo, hi in _windows([_trigger(t) for t in tokens]):
            feats = [[index.setdefault(f, len(index)) for f in fs] for fs in _featured(tokens, lo, hi)]
            rows.append((feats, labels[lo:hi]))
    L, R, T = len(LABELS), len(rows), max(len(y) for _, y in rows)
    live = np.array([[t < len(y) for t in range(T)] for _, y in rows])
    want = np.array([[y[t] if t < len(y) else 0 for t in range(T)] for _, y in rows])
    x = np.zeros((int(live.sum()), len(index)), np.float32)
    for i, fs in enumerate(fs for feats, _ in rows for fs in feats):
        x[i, fs] = 1
    last = live.sum(1) - 1
    bad = _forbidden()
    emit, trans = np.zeros((len(index), L)), np.zeros((L, L))
    # label pairs of the table, with O before and after every row
    pairs = np.zeros((L, L))
    for _, y in rows:
        np.add.at(pairs, ([0, *y], [*y, 0]), 1)
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in (emit, trans)]
    for step in range(1, steps + 1):
        turn = np.where(bad, 0.0, np.exp(trans))
        e = np.ones((R, T, L))
        scores = x @ emit.astype(np.float32)
        e[live] = np.exp(scores - scores.max(axis=1, keepdims=True))
        a, b = np.zeros((T, R, L)), np.zeros((T, R, L))
        for t in range(T):
            a[t] = (turn[0] if t == 0 else a[t - 1] @ turn) * e[:, t]
            a[t] /= a[t].sum(axis=1, keepdims=True)
        for t in range(T - 1, -1, -1):
            inner = (e[:, t + 1] * b[t + 1]) @ turn.T if t + 1 < T else np.ones((R, L))
            b[t] = np.where((last == t)[:, None], turn[:, 0], inner)
            b[t] /= b[t].sum(axis=1, keepdims=True)
        p = a * b
        p = (p / p.sum(axis=2, keepdims=True)).transpose(1, 0, 2)
        gap = -p[live]
        gap[np.arange(len(gap)), want[live]] += 1
        ge = x.T @ gap.astype(np.float32) - decay * emit
        gt = pairs - decay * trans
        gt[0] -= p[:, 0].sum(0)
        gt[:, 0] -= p[np.arange(R), last].sum(0)
        for t in range(1, T):
            own = live[:, t]
            to = e[own, t] * b[t][own]
            mass = a[t - 1][own] @ turn
            gt -= turn * (a[t - 1][own].T @ (to / (mass * to).sum(axis=1, keepdims=True)))
        gt[bad] = 0
        for w, g, (m, v) in ((emit, ge, state[0]), (trans, gt, state[1])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return ShapeField(index, emit, np.where(bad, -1e9, trans))


def _featured(tokens: list[str], lo: int, hi: int) -> list[list[str]]:
    """Features of the tokens from ``lo`` to ``hi``."""
    wide = ["", "", *tokens, "", ""]
    return [features([wide[i + 1], wide[i]], wide[i + 2], [wide[i + 3], wide[i + 4]]) for i in range(lo, hi)]


def barred(tokens: list[str], gaps: list[str]) -> np.ndarray:
    """Labels that a token can't carry: none but O with a symbol in it, no name with a digit, and no
    continuation behind the end of a sentence or clause (an initial's point ends none) or of a line.
    ``gaps`` has the blanks before each token."""
    out = np.zeros((len(tokens), len(LABELS)), bool)
    for t, token in enumerate(tokens):
        if _SYMBOL.search(token):
            out[t, 1:] = True
        elif _SIGN.search(token):
            out[t, _NAMES] = True
        if t and ("\n" in gaps[t] or (tokens[t - 1][-1] in ".,;:!?" and not _INITIAL.fullmatch(tokens[t - 1]))):
            out[t, _INSIDE] = True
    return out


def _runs(flags: list[bool]) -> list[tuple[int, int]]:
    out, start = [], None
    for i, f in enumerate([*flags, False]):
        if f and start is None:
            start = i
        elif not f and start is not None:
            out.append((start, i))
            start = None
    return out


def _left(text: str, at: int, n: int) -> list[tuple[int, int]]:
    """The last ``n`` tokens before position ``at``."""
    out: list[tuple[int, int]] = []
    while len(out) < n:
        while at > 0 and text[at - 1] in _BLANKS:
            at -= 1
        if not at:
            break
        end, at = at, 1 + max(text.rfind(c, 0, at) for c in _BLANKS)
        out.append((at, end))
    return out[::-1]


def _right(text: str, at: int, n: int) -> list[tuple[int, int]]:
    """The first ``n`` tokens from position ``at`` on."""
    out = []
    while len(out) < n and (m := _TOKEN.search(text, at)):
        out.append(m.span())
        at = m.end()
    return out


def marked_tokens(text: str):
    """(start, end) of every token with a mark."""
    cues, k, done = _cues(text), 0, 0
    m = _SIGN.search(text)
    while m or k < len(cues):
        at = min(m.start() if m else len(text), cues[k] if k < len(cues) else len(text))
        start = max(1 + max(text.rfind(c, done, at) for c in _BLANKS), done)
        done = _TOKEN.match(text, start).end()
        yield start, done
        while k < len(cues) and cues[k] < done:
            k += 1
        if m and m.start() < done:
            m = _SIGN.search(text, done)


def field_runs(text: str, taken=()):
    """Stretches around marks: lists of (start, end) of their tokens, and their features. Tokens that lie
    within one of the sorted ``taken`` spans (start, kind, end) mark nothing."""
    runs: list[list[tuple[int, int]]] = []
    k, free = 0, []
    for a, b in marked_tokens(text):
        while k < len(taken) and taken[k][2] <= a:
            k += 1
        if not any(x[0] <= a and b <= x[2] for x in taken[k : k + len(KINDS)]):
            free.append((a, b))
    for a, b in free:
        if runs and a < runs[-1][-1][1]:
            while runs[-1] and runs[-1][-1][1] > a:  # the stretch so far reaches beyond this mark
                runs[-1].pop()
            runs[-1] += [(a, b), *_right(text, b, REACH)]
            continue
        before = [x for x in _left(text, a, REACH) if not runs or x[0] >= runs[-1][-1][1]]
        near = [*before, (a, b), *_right(text, b, REACH)]
        if runs and not text[runs[-1][-1][1] : near[0][0]].strip(_BLANKS):
            runs[-1] += near
        else:
            runs.append(near)
    for run in runs:
        lead, tail = _left(text, run[0][0], 2), _right(text, run[-1][1], 2)
        tokens = [text[a:b] for a, b in (*lead, *run, *tail)]
        yield run, _featured(tokens, len(lead), len(lead) + len(run))


def field_spans(field: ShapeField, texts: list[str], margin: float = MARGIN, taken: list | None = None) -> list[list[tuple[int, int, int]]]:
    """(start, kind index, end) per text; the punctuation around a span is not part of it. ``taken`` has the
    sorted spans of each text whose tokens are O."""
    jobs, emits = [], []
    for i, text in enumerate(texts):
        held = taken[i] if taken else ()
        for run, feats in field_runs(text, held):
            gaps = ["", *(text[a:b] for (_, a), (b, _) in zip(run, run[1:]))]
            scores = field.scores(feats)
            scores[barred([text[a:b] for a, b in run], gaps)] = -1e9
            for a, _, b in held:
                if a < run[-1][1] and run[0][0] < b:
                    scores[[t for t, x in enumerate(run) if a < x[1] and x[0] < b], 1:] = -1e9
            jobs.append((i, run))
            emits.append(scores)
    out: list[list] = [[] for _ in texts]
    for (i, run), path, scores in zip(jobs, field.viterbi(emits), emits):
        t = 0
        while t < len(run):
            if LABELS[path[t]][0] == "B":
                kind, u = LABELS[path[t]][2:], t + 1
                while u < len(run) and LABELS[path[u]] == f"I-{kind}":
                    u += 1
                if field.gain(path, scores, t, u) >= margin:
                    a, b = run[t][0], run[u - 1][1]
                    while b > a + 1 and texts[i][b - 1] in _EDGES:
                        b -= 1
                    while b > a + 1 and texts[i][a] in "\"'":
                        a += 1
                    out[i].append((a, len(KINDS) + FIELD_KINDS.index(kind), b))
                t = u
            else:
                t += 1
    return out


def _joined(spans) -> str:
    names = (*KINDS, *FIELD_KINDS)
    return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_pii long"


def pii(spark: SparkSession, docs: DataFrame, field: ShapeField | None = None) -> DataFrame:
    """Counts, the digest of the base spans, all spans and their number per document row. The field leaves the
    tokens of base spans alone; base spans always stay."""
    wc.prepare(spark)
    if field is None:
        field = train()

    def run(batches):
        for batch in batches:
            _, off = wc.column_bytes(batch.column(1))
            for lo, hi in wc.slices(off):
                texts = pc.fill_null(batch.column(1).slice(lo, hi - lo), "").to_pylist()
                fixed = [base_spans(text) for text in texts]
                added = field_spans(field, texts, taken=fixed)
                cols: list[list] = [[] for _ in range(7)]
                for base, more in zip(fixed, added):
                    for k in range(4):
                        cols[k].append(sum(x[1] == k for x in base))
                    cols[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    free = [x for x in more if not any(x[0] < b and a < x[2] for a, _, b in base)]
                    cols[5].append(_joined(sorted([*base, *free])))
                    cols[6].append(len(base) + len(free))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:6]), pa.array(cols[6], pa.int64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
