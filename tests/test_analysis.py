"""Typed tokens of product names against expected values."""

from __future__ import annotations

from dataclasses import replace

import pytest

from lexiloom.operators.rules import Options, analyse
from lexiloom.operators.segment import Dictionaries, fold, segment

# Dictionary words of the examples.
UNITS = "달러 단계 온스 원 KG CM MM 개 개월 GB GHZ 일 종 장 TB 호 l 인 인용 Ø G ￦ W 세대 인치 % dBi".split()
WORDS = "키 키키 침대 매트리스 충전 배터리 가족용 텐트 리모컨 맥북 에어 베가 타이탄 서랍장 룸 출력 충전기 최대 브라운 정품 테니스화".split()
D = Dictionaries(
    words={fold(w): -8.0 for w in WORDS},
    user=frozenset({fold("pa++")}),
    stop=frozenset({fold("판매")}),
    units=frozenset(map(fold, UNITS)),
    space={"립스테이크": ("립", "스테이크")},
    compound={"테니스화": ("테니스", "신발")},
    synonyms={"LG": ("엘지", "엘쥐"), "집업": ("짚업", "zip up")},
    unit_synonyms={"TB": ("테라", "테라바이트"), "GB": ("기가", "기가바이트")},
)

# Text, then each token's term and type, for an index. A A stands for ALPHA, N NUMBER, M MODEL_NAME, U UNIT, X ALPHANUM, H HANGUL.
INDEX = """
abcde1234#|abcde1234 M|abcde A|1234 N
a-1|a-1 M
1-a|1-a M
a#b|a A|b A
a+b|a A|b A
a/b|a/b M
1-|1 N
c+|c A
pa++|pa++ H
abcde#1234|abcde A|1234 N
abc#abc|abc A|abc A
b923#|b923 M|b A|923 N
A-4|A-4 M
AB-1|AB-1 M|AB A|1 N
a/1/b|a/1/b M|a A|1 N|b A
abc123|abc123 M|abc A|123 N
abc-123|abc-123 M|abc A|123 N
abc123d4efg56|abc123d4efg56 M|abc A|123 N|d A|4 N|efg A|56 N
123456|123456 M
123-456|123-456 M|123456 M|123 N|456 N
123-456/|123-456 M|123456 M|123 N|456 N
abc-123-|abc-123 M|abc A|123 N
nt-ok123|nt-ok123 M|ntok A|nt A|ok123 M|ok A|123 N
ma-9999aa|ma-9999aa M|ma A|9999aa M|9999 N|aa A
abc-a123cc9|abc-a123cc9 M|abca A|abc A|a123cc9 M|a A|123 N|cc A|9 N
ab-ab1|ab-ab1 M|abab A|ab A|ab1 M|ab A|1 N
a1|a1 M
a1b|a1b M
a12c|a12c M|a A|12 N|c A
abc12d-e34|abc12d-e34 M|abc A|12 N|de A|d A|e A|34 N
abc/def|abc/def M|abcdef A|abc A|def A
에어+|에어 H
u43f|u43f M|u A|43 N|f A
zd360-gd60k|zd360-gd60k M|zd A|360 N|gd A|60 N|k A
abc123d-ef456|abc123d-ef456 M|abc A|123 N|def A|d A|ef A|456 N
rs833gsme1v|rs833gsme1v M|rs A|833 N|gsme A|1 N|v A
베가lte-a|베가 H|lte-a M|ltea A|lte A|a A
r-f874hbsw|r-f874hbsw M|rf A|r A|f874hbsw M|f A|874 N|hbsw A
md760kh/a|md760kh/a M|md A|760 N|kha A|kh A|a A
타이탄 a.e.|타이탄 H|a.e M
u560-g.ah30k|u560-g.ah30k M|u A|560 N|g A|ah A|30 N|k A
1개|1개 U|1 N
123/456|123 N|456 N
123/456-|123 N|456 N
2.9|2.9 N
1,234|1,234 N|1234 N
1,234,567.890|1,234,567.890 N|1234567.890 N
1,500원|1,500원 U|1500원 U|1,500 N|1500 N
230x140x1.6cm|230 N|140 N|1.6cm U|1.6 N
110000원|110000원 U|110000 N
HSB005A.3인용|HSB005A M|HSB A|005 N|A A|3인용 U|3 N
G00152827248|G00152827248 M|G A|00152827248 M
123456+|123456 M
12345/12345|12345 M|12345 M
3인용가족용|3인용 U|3 N|가족용 H
1b-12345|1b-12345 M|1b X|12345 M
b1/a2s|b1/a2s M|b1 X|a2s X|a A|2 N|s A
mm/300mm/(1EA|mm A|300mm U|300 N|1EA M|1 N|EA A
111/222/333|111 N|222 N|333 N
1/2/3|1 N|2 N|3 N
100mm/200mm/300mm|100mm U|100 N|200mm U|200 N|300mm U|300 N
TOP-12호|TOP A|12호 U|12 N
f2.8|f2.8 M|f A|2.8 N
c9-123567|c9-123567 M|c9 X|9123567 M|123567 M
d9-b|d9-b M|d9 X|b A
d8-1|d8-1 M|d8 X|81 N|1 N
1b/a2s|1b/a2s M|1b X|ba A|a2s X|a A|2 N|s A
9c-abcdef|9c-abcdef M|9c X|cabcdef A|abcdef A
8a/b|8a/b M|8a X|ab A|b A
7b-3|7b-3 M|7b X|3 N
NT940X3G-K54|NT940X3G-K54 M|NT A|940 N|X A|3 N|GK A|G A|K A|54 N
AKSO-1X|AKSO-1X M|AKSO A|1X X
AKSO-1G|AKSO-1G M|AKSO A|1G X
1A-B2C3D4|1A-B2C3D4 M|1A X|AB A|B2C3D4 X|B A|2 N|C A|3 N|D A|4 N
a123456|a123456 M|a A|123456 M
I7-4700MQ (2.4GHZ)|I7-4700MQ M|I7 X|74700 M|4700 N|MQ A|2.4GHZ U|2.4 N
ABC4+123A|ABC4 M|ABC A|4 N|123A M|123 N|A A
2룸|2 N|룸 H
1-2인용 텐트|1 N|2인용 U|2 N|텐트 H
HSB005A1.3인용|HSB005A M|HSB A|005 N|A A|1.3인용 U|1.3 N
HSB005A1-3인용|HSB005A1 M|HSB A|005 N|A A|1 N|3인용 U|3 N
A1-3인용|A1 M|3인용 U|3 N
A.3인용|A A|3인용 U|3 N
1-3인용|1 N|3인용 U|3 N
B5M-D3H|B5M-D3H M|B5M X|B A|5 N|MD A|M A|D3H X|D A|3 N|H A
GIGABYTE GA-H61M-DS2V (B3)|GIGABYTE A|GA-H61M-DS2V M|GAH A|GA A|H61M-DS2V M|H A|61 N|MDS A|M A|DS A|2 N|V A|B3 M
P5G41T-M LX|P5G41T-M M|P A|5 N|G A|41 N|TM A|T A|M A|LX A
M5A97 EVO|M5A97 M|M A|5 N|A A|97 N|EVO A
P8H61-M PLUS2|P8H61-M M|P A|8 N|H A|61 N|M A|PLUS2 M|PLUS A|2 N
Z9PE-D8 WS STCOM|Z9PE-D8 M|Z A|9 N|PED A|PE A|D8 X|WS A|STCOM A
a1-b2|a1-b2 M|a1 X|b2 X
123abc.b9|123abc.b9 M|123 N|abc A|b9 X
10cmx12cm|10cm U|10 N|12cm U|12 N
100mmx120mmx300mm|100mm U|100 N|120mm U|120 N|300mm U|300 N
5cmx5cm|5cm U|5 N|5cm U|5 N
A&B|A&B M
서랍장(22.6x18.8cm)|서랍장 H|22.6 N|18.8cm U|18.8 N
18v충전배터리|18v M|18 N|v A|충전 H|배터리 H
15키|15 N|키 H
15키키|15 N|키키 H
침대매트리스s|침대 H|매트리스 H|s A
air+|air A
a4|a4 M
b4|b4 M
abc123def456|abc123def456 M|abc A|123 N|def A|456 N
ab1|ab1 M|ab A|1 N
1+|1 N
abc123d|abc123d M|abc A|123 N|d A
23en43v|23en43v M|23 N|en A|43 N|v A
sd550-pd6ok|sd550-pd6ok M|sd A|550 N|pd A|6 N|ok A
27ea53vq|27ea53vq M|27 N|ea A|53 N|vq A
15nd530-px7dk|15nd530-px7dk M|15 N|nd A|530 N|px A|7 N|dk A
gx1|gx1 M|gx A|1 N
k5|k5 M
Air+|Air A
1111/2222/3333|1111 N|2222 N|3333 N
a/2/b|a/2/b M|a A|2 N|b A
S24D390|S24D390 M|S A|24 N|D A|390 N
SD550-PD65K|SD550-PD65K M|SD A|550 N|PD A|65 N|K A
FP166DWCW|FP166DWCW M|FP A|166 N|DWCW A
A12|A12 M|A A|12 N
1abcdef|1abcdef M|1 N|abcdef A
P54M|P54M M|P A|54 N|M A
A 1-3인용|A A|1 N|3인용 U|3 N
A-3인용|A A|3인용 U|3 N
1.3인용|1.3인용 U|1.3 N
B75M-D3H|B75M-D3H M|B A|75 N|MD A|M A|D3H X|D A|3 N|H A
M4A87TD EVO|M4A87TD M|M A|4 N|A A|87 N|TD A|EVO A
맥북에어 11인치|맥북 H|에어 H|11인치 U|11 N
어답터/DC/AC/출력1.5V/2V/3V/4.5V/5V/7.5V/9V/600MA/충전기|어답터 H|DC/AC M|DCAC A|DC A|AC A|출력 H|1.5V/2V/3V/4.5V/5V/7.5V/9V/600MA M|1.5 N|V A|2V X|3V X|4.5 N|V A|5V X|7.5 N|V A|9V X|600 N|MA A|충전기 H
abc123-a9|abc123-a9 M|abc A|123 N|a9 X
100mmx120mm|100mm U|100 N|120mm U|120 N
I&U|I&U M
G&B|G&B M
M&A|M&A M
침대매트리스 s|침대 H|매트리스 H|s A
""".strip().splitlines()

# The same for a query, where the parts of a term follow it after a colon.
QUERY = """
1b-12345|1b-12345 M: 1b X, 12345 M
b1/a2s|b1/a2s M: b1 X, a2s X, a A, 2 N, s A
c9-123567|c9-123567 M: c9 X, 123567 M
d8-1|d8-1 M: d8 X, 1 N
1b/a2s|1b/a2s M: 1b X, a2s X, a A, 2 N, s A
9c-abcdef|9c-abcdef M: 9c X, abcdef A
AKSO-1G|AKSO-1G M: AKSO A, 1G X
1A-B2C3D4|1A-B2C3D4 M: 1A X, B2C3D4 X, B A, 2 N, C A, 3 N, D A, 4 N
Z9PE-D8 WS STCOM|Z9PE-D8 M: Z A, 9 N, PE A, D8 X|WS A|STCOM A
a1-b2|a1-b2 M: a1 X, b2 X
z4|z4 M
123abc.b9|123abc.b9 M: 123 N, abc A, b9 X
10cmx12cm|10cm U|12cm U
A&B|A&B M
d9-b|d9-b M: d9 X, b A
8a/b|8a/b M: 8a X, b A
7b-3|7b-3 M: 7b X, 3 N
AKSO-1X|AKSO-1X M: AKSO A, 1X X
어답터/DC/AC/출력1.5V/2V/3V/4.5V/5V/7.5V/9V/600MA/충전기|어답터 H|DC/AC M: DC A, AC A|출력 H|1.5V/2V/3V/4.5V/5V/7.5V/9V/600MA M: 1.5 N, V A, 2V X, 3V X, 4.5 N, V A, 5V X, 7.5 N, V A, 9V X, 600 N, MA A|충전기 H
abc123-a9|abc123-a9 M: abc A, 123 N, a9 X
100mmx120mm|100mm U|120mm U
100mmx120mmx300mm|100mm U|120mm U|300mm U
5cmx5cm|5cm U|5cm U
I&U|I&U M
G&B|G&B M
M&A|M&A M
서랍장(22.6x18.8cm)|서랍장 H|22.6 N|18.8cm U
""".strip().splitlines()

# Index tokens that need more dictionary words.
MORE_WORDS = "엑슬 비젼 보온 밥솥 개봉 반품 불 세일 무료 배송 무이자 할부 오랄비 전동 칫솔모 프리 시즌 클린 신형 총 아디다스 세트".split()
MORE = """
1세트(4개)  [최대 12개월 무이자할부]브라운 오랄비 전동칫솔모 프리시즌클린 신형 칫솔모 총8개  EB20-4X2  / 정품.브라운.오랄비.|1 N|세트 H|4개 U|4 N|최대 H|12개월 U|12 N|무이자 H|할부 H|브라운 H|오랄비 H|전동 H|칫솔모 H|프리 H|시즌 H|클린 H|신형 H|칫솔모 H|총 H|8개 U|8 N|EB20-4X2 M|EB A|204 N|20 N|4X2 X|4 N|X A|2 N|정품 H|브라운 H|오랄비 H
엑슬비젼 BYSUO T1 + IN WIN PC 리모컨|엑슬 H|비젼 H|BYSUO A|T1 M|IN A|WIN A|PC A|리모컨 H
엑슬비젼 BYSUO T1+IN WIN PC 리모컨|엑슬 H|비젼 H|BYSUO A|T1 M|IN A|WIN A|PC A|리모컨 H
보온밥솥 6인 CR-0613R/0622R/0632FV/0651FR/0661G/O|보온 H|밥솥 H|6인 U|6 N|CR-0613R/0622R/0632FV/0651FR M|CR A|0613R/0622R/0632FV/0651FR M|0613 N|R A|0622 N|R A|0632 N|FV A|0651 N|FR A|0661G U|0661 N|O A
아디다스테니스화50%세일무료배송|아디다스 H|테니스화 C|테니스 C|신발 C|50% U|50 N|세일 H|무료 H|배송 H
""".strip().splitlines()

SHORT = {"ALPHA": "A", "NUMBER": "N", "MODEL_NAME": "M", "UNIT": "U", "ALPHANUM": "X", "HANGUL": "H", "COMPOUND": "C"}


@pytest.mark.parametrize("line", INDEX)
def test_index_tokens(line):
    text, *want = line.split("|")
    assert [f"{t.term} {SHORT[t.type]}" for t in analyse(text, D)] == want


@pytest.mark.parametrize("line", MORE)
def test_index_tokens_with_more_words(line):
    text, *want = line.split("|")
    wide = replace(D, words=D.words | {fold(w): -8.0 for w in MORE_WORDS})
    assert [f"{t.term} {SHORT[t.type]}" for t in analyse(text, wide)] == want


@pytest.mark.parametrize("line", QUERY)
def test_query_tokens(line):
    text, *want = line.split("|")
    got = []
    for t in analyse(text, D, Options(for_query=True)):
        parts = ", ".join(f"{x.term} {SHORT[x.type]}" for x in t.extras)
        got.append(f"{t.term} {SHORT[t.type]}" + (f": {parts}" if parts else ""))
    assert got == want


def test_offsets_stop_words_and_options():
    spans = [(t.term, t.start, t.stop) for t in analyse("침대매트리스 s", D)]
    assert spans == [("침대", 0, 2), ("매트리스", 2, 6), ("s", 7, 8)]
    assert [t.term for t in analyse("침대 판매", D)] == ["침대"]
    kept = analyse("침대 판매", D, Options(drop_stop=False))
    assert [(t.term, t.type) for t in kept] == [("침대", "HANGUL"), ("판매", "STOPWORD")]
    full = analyse("침대 LG ", D, Options(for_query=True, full_string=True))
    assert (full[0].term, full[0].type) == ("침대 LG", "FULL_STRING") and full[2].synonyms == ["엘지", "엘쥐"]
    assert analyse("집업", D, Options(for_query=True))[0].synonyms == ["짚업", "zip up"]
    assert analyse("1TB", D, Options(for_query=True))[0].synonyms == ["1테라", "1테라바이트"]
    assert [(t.term, t.type, t.pos_inc) for t in analyse("테니스화", D)] == [("테니스화", "COMPOUND", 1), ("테니스", "COMPOUND", 0), ("신발", "COMPOUND", 0)]
    assert [(t.term, t.type) for t in analyse("테니스화", D, Options(for_query=True))] == [("테니스화", "HANGUL")]
    assert analyse(None, D) == [] == analyse("  ", D)
    assert [t.term for t in analyse("ab1 é", D, Options(uppercase=True))][:1] == ["AB1"]
    assert [t.term for t in analyse("립스테이크", D)] == ["립", "스테이크"]


def test_segment_particles_and_unknown_words():
    words = lambda t: [(t[a:b], k) for a, b, k in segment(t, D)]
    assert words("침대는") == [("침대", True), ("는", True)]
    assert words("텐트을")[0] == ("텐트", True) and words("텐트을")[1][1] is False
    assert words("쀍뚫침대") == [("쀍뚫", False), ("침대", True)]
    assert segment("", D) == []


RETYPED = Dictionaries(words={fold(w): -8.0 for w in ("2인용", "1.5cm", "a1", "b2", "x-1", "q7z", "한글")}, user=frozenset({"Q7", "C-3"}), units=frozenset({"인용", "CM"}))

# Text, then terms and types.
RETYPED_ROWS = """
2인용|2인용 UNIT|2 NUMBER
1.5cm|1.5cm UNIT|1.5 NUMBER
a1|a1 HANGUL
c-3|c-3 MODEL_NAME
q7|q7 MODEL_NAME
한글|한글 HANGUL
漢字かな|漢字かな JAPANESE
かな漢字カナ|かな漢字カナ JAPANESE
漢字|漢字 CHINESE
漢字abc|漢字 CHINESE|abc ALPHA
"""


@pytest.mark.parametrize("row", RETYPED_ROWS.split("\n")[1:-1])
def test_words_that_are_typed_by_their_characters(row):
    text, *want = row.split("|")
    assert [f"{t.term} {t.type}" for t in analyse(text, RETYPED, Options())] == want


def test_short_words_fall_apart_beside_letters():
    for text in ("a1#", "#a1"):
        assert [(t.term, t.type) for t in analyse(text, RETYPED, Options())] == [("a1", "MODEL_NAME")]
