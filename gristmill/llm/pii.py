"""Personal information inside free text, found and replaced by typed placeholders.

The model is the semi-Markov field of ``semicrf`` over the candidates of ``pii_spans``; it is fitted on sentences that are
made up here (``made_up``, a bounded number) and sent to the tasks. Texts are read whole, one at a time.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.pii_spans import BODIES, FAMILY, GIVEN, GIVEN_ONE, GIVEN_TWO, HONORIFICS, LABELS, LONG_SURNAMES, MORE_NAMES, ORDINARY_KO, ROLES, SURNAMES, TITLES, TYPES, candidates, view
from gristmill.llm.semicrf import SemiMarkov
from gristmill.session import spread

PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Sentences that the model is fitted on.
SENTENCES = 10_000

# ---- made-up sentences ----------------------------------------------------------------------------------------------------

# Frames of our own: what people write around personal values, and around things that only look like them.
_WITH = """
{role} <name> <email>|{role} <name>, <phone>|{role} <name> (<email>)|{role}: <name>|{role}: <name> / <phone>|{role} <name>|{role} <name> {hon} {verb}|{role} <name>{p} {verb}|{role}=<name>, mail=<email>|{role}=<name>;{thing}=<phone>|{role} : <name> ({n4})
{label}: <name>|{label} <name>|{label}: <name> / 주민번호 <id_number>|{label} : <name>, {thing} : <phone>|{label}: <name>\n주소: <address>|{label}은 <name>이다|{label} | <name> | <phone>|{label} | <name> | <email> | <address>
<name> 씨가 {verb}|<name> 씨는 {thing}{o} {verb}|<name> 씨의 {thing}|<name> {hon}께 {thing}{o} 보냈다.|<name>{hon}이 {verb}|<name> {hon}의 {thing} <email>|<name>의 {thing} <phone>|<name>의 새 주소는 <address>|<name>의 사무실은 <address>에 있다.|<name>의 집 <address>
<name>{p} {verb}|<name>{p} {thing}{o} {verb}|{when} <name>{p} {verb}|{thing}에서 <name>{p} {thing}{o} {verb}|{when} {thing}{o} <name>{p} {verb}|{noun}{p} <name>에게 {verb}|{noun}{o} <korean>한테 빌렸다.|<korean>{p} {noun}{o} {verb}|<korean>{p} {verb}|{when} <korean>{p} {noun}{o} {verb}|{noun} <korean>{p} {verb}|{noun}에서 <korean>{o} {verb}|<korean>, {when} {verb}|<korean>의 {noun}|{noun} - <korean>|{noun}: <korean>|<korean>{p} {noun}{p} {verb}|<name>, <name> 두 사람이 {verb}|<name>과 <name>이 {when} {verb}
<name> 드림|<name> 올림|<name> 배상|{thing} 담당은 <name>, {thing} 담당은 <name>이다.|저는 <name>입니다.|저는 <name>이라고 합니다.|{role} <name>과 {role} <name>{p} {verb}|"{label}": "<name>", "{thing}": "<phone>"|{role} <name> 진술에 따르면 <address>였다.|<name> 거주지 <address>
<name> {title}{p} {verb}|<name> {title}|<name> {title}의 {thing}|<name> {hon} 신청분|<name>({n2})|<name>: {noun}{o} {verb}|<name> <phone>|<name> <email>|<name> (<id_number>)|<name>, <address>, <phone>|<name> / <id_number> / <address>|{role} <name>, <address>|{role} <name> <id_number>|{role} <name> ({id}) 대신 <phone>|보낸이 <name>\n가는 곳 <address>
주민번호 <id_number>|{noun} 등록 번호 <id_number>|면허 <id_number> 소지|면허증 <id_number>{p} {verb}|번호 <id_number>{o} {verb}|신분 확인 <id_number>|개인 번호는 <id_number>|외국인 등록 <id_number>|{thing} 삭제 대상 <id_number>|식별 번호 <id_number>, 휴대폰 <phone>|고객 번호 대신 <id_number>{o} 적었다.
전화 <phone>|연락은 <phone>|휴대폰 <phone>{o} {verb}|<phone>로 {verb}|{thing} <phone>, {thing} <phone>|Tel.<phone>|☎ <phone>|팩스 <phone> 전화 <phone>|{noun} 예약 <phone>|<phone> 번으로 걸면 된다.|{thing} <phone> 또는 <email>|문자 <phone>
메일 <email>|전자 메일은 <email>{o} 쓴다.|<email>로 {verb}|<email> 앞으로|답은 <email>에 남겨 주세요.|{noun} 신고 <email>|{thing}: <email>|TO="<email>"|<email>{p} {verb}|<<email>>|[<email>]|{noun}은 <email> 하나뿐이다.
주소 <address>|<address>에 산다.|<address>으로 옮겼다.|{thing} 받을 주소: <address>|<address>에서 {verb}|{noun}{p} <address> 부근이다.|<address> 앞|<address>의 {noun}|소재지 <address>|{when} <address>에 {verb}|<address>
{erole} <name> {everb}|{erole} <name>|{erole}: <name>|{erole}: <name>, <phone>|{erole}: <name> <<email>>|# {erole} <name> <<email>>|// {erole} <name> <phone>|{erole} <name> (<email>) {everb}|{erole} <name>, ID <id_number>|"{elabel}": "<name>", "mail": "<email>"|{'{elabel}': '<name>', 'phone': '<phone>', 'home': '<address>'}
<known> {everb}|when <known> {everb}|that <known> {everb}|the old <known> {everb}|<known> and her {enoun}|with <known> or <known>|for <known>'s {enoun}|to <known>|<known> is my {enoun}.|<known> had the {enoun}.|a {enoun} for <known>|seen <known> there|<known> was at the {enoun}.|<known> was {c}|<known> is {c} {c}|<known> has {c}|with <known> {c}|{c} <known> in {n4}|<known> at {n2}|{word} <known> {everb}|<known> has a {enoun}|<known>!|<known> {everb} the {enoun}.|The {enoun} was signed by <known>.|by <known>|Photo: <known>|<known>, {n2}, {everb}|<known> and <known> {everb}|My {enoun} came from <known>.|We met <known> near the {enoun}.|It was <known> who {everb} it.|<known>'s {enoun}|"Not at all," <known> said.|The {enoun}, <known>, {everb}.|Ask <known> about the {enoun}.|Call <known> on <phone>.
Mr. <name> {everb}|Dr <name> {everb}|Dear <name>,|Hello <name>,|Yours, <name>|Best regards, <name>|Kind regards,\n<name>|Signed: <name>|From: <name> <<email>>|To: <name>|Prepared by <name>, tel. <phone>|Write to <name> at <email>.|For details see <name> ({thing} <phone>).|{elabel}: <name>|{elabel} = <name>|<name> | <phone> | <email>|<name>, <address>
<name> lives at <address>.|<name> of <address>|Ship to <address>.|{enoun} at <address> is closed.|Home: <address>|I moved to <address>, phone <phone>.|New address: <address>|Visit <address> after {n2}.|SSN <id_number>|licence no. <id_number>|National ID <id_number>, {elabel} <name>|social security <id_number>|{erole} <name>, licence <id_number>
Phone: <phone>|Fax <phone>|Text <phone> today.|Ring <phone> for the {enoun}.|mobile <phone>; mail <email>|Email <email>|Reply to <email>.|{enoun} bugs: <email>|Send the {enoun} to <email>|mailto:<email>|{enoun} fixes to <email>.|{erole} <name> {hon} {verb}|<name>; <phone>; {place}|{role} <name> {hon}, <phone>
<name>의 전화는 <phone>|<name>의 주소 <address>
{c} <known> {c}|{c} {c} <known>.|<known> {c} {c}|{c} <known>, {c}|{c} <known> {c} {enoun}|{c} {enoun} {c} <known> {c}|<known> {c} the {enoun}|{c}, <known>, {c}|{c} <known> {c} <known>|{c} <known>.|{enoun} {c} <known>|<known> {c} {n4}
"""
_WITHOUT = """
{noun}{p} {title}의 {noun}{o} {verb}|{noun}과 {title}{p} {verb}|{title}{p} {noun}{o} {verb}|{title}, {noun}|{sino} {title}{p} {verb}|{odd} {noun} {n2}%|{noun}하였다고 {verb}|{noun}되며 {noun}{p} {verb}|{noun}하는 {noun}{p} {verb}|{sino}{p} {noun}{o} {verb}|{sino}의 {noun}{p} {verb}|{noun} {sino}{p} {verb}|{sino} {noun}{p} {verb}|{sino}, {sino}, {noun}|{when} {sino}{o} {verb}|- {sino}: {sino}{p} {verb}|{noun}{p} {noun}{o} {verb}|{when} {noun}{p} {verb}|{noun} {noun}{p} {verb}|{noun}의 {noun}{o} {verb}|{noun}과 {noun}{p} {when} {verb}|{noun}에서 {noun}까지 {n2}분 걸린다.|{noun} 가운데 {n2}개{p} {verb}|{noun}: {noun}, {noun}|- {noun}: {noun}{p} {verb}|{noun}, {noun}, {noun}|{noun}에는 {noun}{p} {verb}|{odd}{p} {verb}|{odd}의 {noun}{p} {verb}|{odd}에서 {noun}{o} {verb}|{odd}과 {odd} 사이에서 {noun}{p} {verb}|{odd} {noun}|{odd}|({odd}, {n4}) {noun} 보기.|{odd}식 {noun}|{noun} {odd}{p} {verb}|<p>{odd}</p>|{n2}번째 {noun}{p} {odd}의 {noun}{o} {verb}
{role} {noun}{p} {verb}|{role}{p} {verb}|{role}에게 {noun}{o} 물었다.|{label}{o} 적어 주세요.|{label} {noun}{p} {verb}|{role} {noun} {noun}{o} {verb}|{fam} {hon}께 {verb}|{fam} {hon}{p} {verb}|{role} {fam} {hon}{p} {verb}|{role}, {noun}|{label}, {noun}, {noun} 항목|{role} 여러분|{role} {noun} 안내|이름 모를 {noun}{p} {verb}|{role} 없는 {noun}|대표 {noun}|{role} {noun} {noun} {noun}|{noun} 씨앗{o} {verb}|{role} 회의는 {n2}시에 열린다.
{enoun} of {place} {everb2}|{place} {everb2} the {enoun}.|The {place} {everb2}.|In {place}, the {enoun} {everb2}.|According to {place}, no {enoun} {everb2}.|{place} and {place} {everb2}.|({place}, {n4}) on the {enoun}|Notes on {place}|- {enoun}: {place}|Between {place} and the {enoun}|{heading}|"{heading}" is a song.|{heading} {everb2}.|Long before {thing_name}, the {enoun} {everb2}.|the {enoun} owed {thing_name} nothing|Which one was {thing_name}? A: {thing_name}|Q: Where is {place}?\nA: {place}|Answer: {thing_name}|답: {thing_name}|{thing_name} 열매{p} {verb}|After {place} {everb2}, {thing_name} {everb2}.|as {place} put it|and only {thing_name} {everb} it|{thing_name}|{thing_name}|{place}|{thing_name} {everb} the {enoun}.
{erole} {place} {everb2}|{erole} the {enoun}|{elabel} the {enoun} first.|Contact {place} for the {enoun}.|Ask {heading} again.|Dear {heading},|The {elabel} {word} is common.|Signed copies of {heading}|Regards from {place}|Author notes on {place}|Call the {enoun}.|{word} {word} {n2}.{n1}|by {place}|from {place}|near {place}|with {place}|{place}, {place}|{word}, {word} and {word}|{WORDS}|{WORDS} {word}|class {Camel}({Camel}):|return {Camel}.{camel}();|def {camel}(self):|@{camel}|@{camel} def {camel}|{camel} at {camel}.{camel}|SELECT {camel}, {elabel} FROM {camel} WHERE {camel} = {n2};|WHERE {camel}_id > {n4}|{camel}@{camel}:~$ ls
{c} {place} {c}|{c} {thing_name} {c}|{c} {heading} {c}|{thing_name} {c} {c}|{c} {place}, {c}|{c} {c} {thing_name}.|{place} {c} the {enoun}|{c} {thing_name} {c} {enoun}|{c}, {place}, {c}|{heading} {c} {c}|{place} {c} {n4}|{c} {thing_name} {c} {thing_name}|{c} {thing_name}, {c}|{c} {enoun} {c} {thing_name}.|{thing_name}, {c} {c}|{c} {c} {thing_name} {c}|{WORDS} {c}|{c} {WORDS} {c}|{thing_name} {c} {c} {c}|for {thing_name}, {c}|{thing_name} was {c}|{c} {c} {thing_name}, {c}
{ekind} {n4}-{n2}-{n4}|{ekind} {n3}-{n3}-{n4}|{ekind} no. {n3}-{n2}-{n4}|{ekind} {n6}{n6}{n1}|{ekind} {n1}.{n2}.{n3}|{ekind} {n3}.{n3}.{n4}|{kind} {n4}-{n2}-{n4}|{kind} {n3}-{n2}-{n6}|{kind} {n6}{n6}{n6}|{kind} {n6}{n6}{n1}|{kind} {n4}-{n3}-{n4}|{kind} {n3}-{n2}-{n4} {noun}|{kind} {n1}.{n3}.{n2}|{kind} {n3}.{n3}.{n1} {noun}{p} {verb}|{kind} {n4}-0{n2}-{n4}|{kind} {n6}-{n6}{n1}|{noun} {n4}.{n2}.{n2} ~ {n4}.{n2}.{n2}|{noun} 0{n2}.{n2}에서 0{n2}.{n2}까지|{kind}: {n2}-{n2}-{n6}-{n1}|{n4}년 {noun}{p} {verb}|{n4}년과 {n4}년 사이|{n1},{n3},{n3}원|{noun} {n2}.{n2}%|IP {n3}.{n2}.{n2}.{n1}|{kind} {n3}-{n2}-{n5}
{road} 쪽 {n2}번 버스|{road} 인근 {n2}개 {noun}|{road}에서 {noun}{o} {verb}|{road} {n2}개 {noun}{p} {verb}|{si}에는 {noun}{p} 많다.|{si} {gu}에서 {noun}{o} {verb}|{road}{p} {verb}|{road}부터 {si}까지 {n2}km|{si} 주민 {n3}명{p} {verb}|{street} is {n2} miles long.|The {n2} {street} bus|{street} {everb2}.|Left onto {street}|{town} and {street}|{n2} {word} {street} lines|주소는 곧 알린다.|메일 주소의 골뱅이 앞|전화는 나중에|{noun} @ {noun}|{enoun} @ {n2}|look at the dot above|{enoun} at the dot of {n2}|연락처 {noun}{p} {verb}|전화 {noun}{o} {verb}|{noun} 접수 {noun}
"""
_ROLES_KO, _ROLES_EN = (sorted(w for w in ROLES if w.isascii() == e and w not in _SPLIT_OFF) for e, _SPLIT_OFF in ((False, ()), (True, ("by", "from", "to", "dear", "sir", "called", "named"))))
_LABELS_KO, _LABELS_EN = sorted(w for w in LABELS if not w.isascii()), ["name", "Name", "full name", "Full Name", "NAME", "Customer name"]
_NOUNS = sorted(ORDINARY_KO) + (
    "나무 바다 가방 커피 컴퓨터 자전거 빵집 학교 병원 책상 의자 창문 버스 택시 비행기 냉장고 토마토 달력 거울 모자 구두 축구 야구 농구 수학 과학 물리 화학 생물 역사 철학 논문 실험 이웃집 마을회관 편의점 피자 라디오 텔레비전 카메라 휴대폰 충전기 "
    "바람 구름 햇빛 눈보라 폭우 태양 달빛 별자리 산맥 골짜기 호수 바위 모래 자갈 흙길 다리 육교 골목길 법원 재판 보험 대출 이자 환율 저축 예금 경기장 응원 패배 승리 약국 감기 두통 주사 붕대 화면 자판 단추 목록 파일"
).split()
#: Syllables of many ordinary words.
_COMMON_SYLLABLES = "경기선수원정미인성화자식용구규도전량권력법학장실부서증률비금사소점역관회국체판표품물제적계감간대단등로문방병복산심안약어업열음의지질차책처청통파형중급공과내리모반발분상생세속신양연영외위유이일입재조종주진천출치타통평하합해행향현호환활"
_VERBS = "바뀌었다. 늘었다. 줄었다. 정했다. 골랐다. 보았다. 말했다. 들었다. 옮겼다. 맡았다. 맡는다. 웃었다. 울었다. 떠났다. 도착했다. 기다린다. 시작한다. 끝났다. 썼다. 읽었다. 만들었다. 고쳤다. 물었다. 답했다. 전화했다. 찾아왔다. 다녀갔다. 발표했다. 참석했다. 받았다. 잃어버렸다. 열었다. 샀다. 판다. 좋아한다. 싫어한다. 알려져 있다. 필요하다. 남았다. 이어진다. 확인하였다. 제출했다고 한다. 적혀 있다.".split(" ")
_VERBS = [v for v in " ".join(_VERBS).replace(". ", ".|").split("|")]
_THINGS = "메일 전화 휴대폰 팩스 연락처 문자 이력서 편지 소포 상자 사본 서류 회신 제보 문의 신고 예약 취소 결제 배송".split()
_WHEN = "어제 오늘 내일 지난주 다음 달에 아침에 오후에 밤늦게 그날 방금 다시 해마다 조금씩 오래전에".split()
_PARTICLE = "은 는 이 가 도 만 까지 에게 에서 과 와 의".split()
_ENGLISH_NOUNS = "garden report letter bridge meeting invoice painting ticket recipe window engine lesson song contract budget river harvest parcel shelf lantern crystal verdict orbit kernel".split()
_COMMON = (
    "was is had has will would can could with for by from to and or but near after before when while if at on in of about against between like as than then died married seen sang agreed met called knew saw told asked who whose that this his her their our my the old young late early former new first "
    "last many some every no not very so there here today yesterday again once never always sold kept left gave took made said works lives owns reads plays ran won lost born opened closed began ended went came"
).split()
_PERSON_VERBS = "said told wrote called walked joined signed teaches lives works moved asked answered thanked paid drove painted founded leads won scored laughed resigned complained arrived sang cooked".split()
_BODY_VERBS = "closed opened reported published printed hosted exported was foggy|is large|was ignored|met on Tuesday|has no windows|drew attention|disagree|stands empty|was kept|came up".split("|")
_BODY_VERBS = _BODY_VERBS[0].split()[:-2] + ["was foggy", *_BODY_VERBS[1:]]
_KINDS = "일련번호 관리번호 문서번호 순번 판본 버전 부품번호 제품번호 모델명 송장 운송장 주문번호 측정값 사건번호 접수번호 사업자등록번호 계좌번호".split()
_KINDS_EN = "Serial,Version,Part,Invoice,Order,ISBN,Model,Build,Item,Revision".split(",")
_PLACE_ENDS = sorted(w.capitalize() for w in BODIES)
_ENGLISH_WORDS = "Golden,Silver,Central,Northern,Old,New,Great,Machine,Open,Happy,Blue,Red,Winter,Royal,Deep,Quiet,Salt,Long,Green,United,Public,Lost,Error,Chapter,Terms,Privacy,Customer,Order,Learning,Garden,Story,Data,Page,Version,Music,Science".split(",")
_GIVEN, _FAMILY, _MORE, _GIVEN_ONE, _GIVEN_TWO = sorted(GIVEN), sorted(FAMILY), sorted(MORE_NAMES), sorted(GIVEN_ONE), sorted(GIVEN_TWO)
_MAILS = "hello minho.k sora j_park team contact.us lab admin2 r.white anna.b press-office dev hr daisy77 kwon_s billing no-reply cafe1234 newsdesk paul".split()
_HOSTS = "example.com example.net example.org mail.example.com inbox.example.co.kr lab-1.example.ac.kr shop.example.io a.b.example.de team.example.app news.test host.invalid corp.example.fr".split()
_SI = "서울특별시 부산광역시 대구광역시 인천광역시 광주광역시 대전광역시 울산광역시 세종특별자치시 수원시 성남시 청주시 전주시 창원시 포항시 춘천시 서울시 부산시 대구 인천 서울 부산".split()
_GU = "중구 종로구 강남구 마포구 송파구 해운대구 수성구 유성구 남동구 덕진구 분당구 영통구 동구 서구 북구".split()
_DONG = "역삼동 신사동 봉명동 우동 명동 서교동 잠실동 둔산동 연남동 삼성동".split()
_DO, _GUN, _MYEON, _RI = "경기도 강원도 충청북도 충청남도 전라북도 전라남도 경상북도 경상남도 강원특별자치도".split(), "양평군 홍천군 보은군 부여군 무주군 해남군 의성군 남해군 평창군 춘천시 공주시 안동시".split(), "용문면 청평읍 남산면 서석면 내촌면 유구읍 풍천면 북면 남면 설천면".split(), "산음리 방곡리 석남리 하회리 두길리 수하리 장평리 신리 월곡리".split()
_ROADS = "중앙로 세종대로 테헤란로 판교로 대학로 달구벌대로 태조로 구월로 벚꽃길 느티나무길 강변로 시청로 충무로 을지로 한강대로".split()
_STREETS = "Main Street,Elm Court,King Street,Mill Road,Oak Avenue,Church Lane,Park Drive,Station Road,Victoria Way,Bridge Street,High Street,Cedar Close,Union Square,Rose Terrace".split(",")
_TOWNS = "Springfield,York,Oxford,Leeds,Portland,New Haven,Salem,Bristol,Little Rock,Cambridge,San Diego,Dover".split(",")
_SPOKEN = ["공일이삼사오육칠팔구", "영일이삼사오육칠팔구"]


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _syllable(r: random.Random) -> str:
    """Any Hangul syllable of a common make: one consonant, a vowel, and perhaps a final."""
    return chr(0xAC00 + r.choice([0, 2, 3, 5, 6, 7, 9, 11, 12, 14, 15, 16, 17, 18]) * 588 + r.choice([0, 1, 4, 5, 6, 8, 12, 13, 18, 20]) * 28 + r.choice([0, 0, 0, 0, 1, 4, 8, 16, 17, 21]))


def _invented(r: random.Random, n: int) -> str:
    """A Latin word that nobody uses, made of n open or closed syllables."""
    part = lambda: r.choice(["b", "br", "c", "d", "dr", "f", "g", "h", "k", "l", "m", "n", "p", "qu", "r", "s", "st", "t", "th", "v", "w", "z", ""]) + r.choice(["a", "e", "i", "o", "u", "ae", "ea", "y", "ou"]) + r.choice(["", "", "n", "r", "l", "s", "ck", "nd", "th", "m", "sh", "x"])
    return "".join(part() for _ in range(n)).capitalize()


def _name(r: random.Random) -> str:
    if r.random() < 0.58:
        return _korean(r, 0.6)
    return _western(r, 0.6)


def _korean(r: random.Random, usual: float = 1.0) -> str:
    long = r.random() < 0.07
    family = r.choice(LONG_SURNAMES) if long else r.choice(SURNAMES[:40] if r.random() < 0.75 else SURNAMES)
    if r.random() < usual:
        given = r.choice(_GIVEN_ONE) + r.choice(_GIVEN_TWO)
    else:
        given = r.choice([_syllable(r), r.choice(_GIVEN_ONE)]) + _syllable(r)
    kind = r.random() if usual < 1 else 1.0
    return family + (" " if kind < 0.1 else "") + (given[0] if 0.1 <= kind < 0.15 else given + r.choice(_GIVEN_TWO) if 0.15 <= kind < 0.18 and not long else given)


def _western(r: random.Random, known: float = 0.95) -> str:
    if r.random() < known:
        first, last = (r.choice(names if r.random() < 0.5 else _MORE).capitalize() for names in (_GIVEN, _FAMILY))
    else:
        first, last = _invented(r, r.choice([1, 2, 2])), _invented(r, r.choice([1, 2, 2, 3]))
    last = r.choice(["O'", "Mc", "D'"]) + last if r.random() < 0.08 else last
    kind = r.random()
    if kind < 0.06:
        last += "-" + r.choice(_FAMILY).capitalize()
    elif kind < 0.12:
        first += "-" + r.choice([_invented(r, 1).lower(), r.choice(_GIVEN).capitalize()])
    elif kind < 0.16:
        last = r.choice(["de", "van", "von", "della", "de la", "bin"]) + " " + last
    elif kind < 0.20:
        return f"{first} {last}".upper()
    elif kind < 0.23:
        last = last.replace("a", "á").replace("o", "ö").replace("e", "é")
    elif kind < 0.26:
        return f"{last}, {first}"
    elif kind < 0.30:
        first += " " + r.choice(_GIVEN).capitalize()
    elif kind < 0.33:
        return f"{r.choice(_FAMILY).capitalize()} {_invented(r, 1)}-{_invented(r, 1).lower()}"
    middle = "".join(f" {r.choice('ABCDEFGHJKLMNPRSTW')}." for _ in range(r.random() < 0.2))
    return f"{first}{middle} {last}"


def _email(r: random.Random) -> str:
    local = r.choice(_MAILS) + r.choice(["", "", r.choice(["_", ".", "-", ""]) + r.choice(_MAILS), r.choice(["_", ".", "-", ""]) + _digits(r, 3), "+" + r.choice(["news", "kr", "test1"])])
    host = r.choice(_HOSTS)
    kind = r.random()
    if kind < 0.1:
        return r.choice(["운영자", "총무팀", "예약.접수", "도움말"]) + "@" + r.choice([*_HOSTS, "가게.한국", "학교.테스트"])
    if kind < 0.55:
        mail = f"{local}@{host}"
        return mail.upper() if r.random() < 0.1 else mail.title() if r.random() < 0.1 else mail
    if kind < 0.8:
        return local + r.choice(["@", "＠", " @ ", " (at) ", " [at] ", "(at)", "[at]", " 골뱅이 ", "골뱅이", "(골뱅이)", "{at}"]) + r.choice([host, host, host, host.replace(".", "[.]"), host.replace(".", "(dot)")])
    return f"{local} {r.choice(['at', 'at', 'AT', '골뱅이'])} " + host.replace(".", r.choice([" dot ", " dot ", " DOT ", " 점 "]))


def _phone(r: random.Random) -> str:
    a, b = "0" + _digits(r, 3), _digits(r, 4)
    kind = r.randrange(12)
    if kind < 4:
        s = r.choice(["-", "-", "-", ".", " ", " - "])
        return f"{r.choice(['010', '010', '011', '016', '070', '019'])}{s}{a}{s}{b}"
    if kind == 4:
        return r.choice([f"010{a}{b}", f"010{a}{b}", f"010-{a}{b}", f"010{a}-{b}", f"82-10-{a}-{b}"])
    if kind == 5:
        plain = f"010-{a}-{b}"
        return plain.translate({ord(c): ord(c) + 0xFEE0 for c in "0123456789-"})
    if kind == 6:
        return r.choice(["+82 10-{}-{}", "+82-10-{}-{}", "+82-(0)10-{}-{}", "+82 (0)10-{}-{}", "+8210{}{}"]).format(a, b)
    if kind == 7:
        s = r.choice("- ")
        return r.choice([f"+1{s}{r.choice(['415', '202'])}{s}555{s}01{b[:2]}", f"(202) 555-01{b[:2]}", f"202-555-01{b[:2]}", f"+44 20 7946 0{b[:3]}", f"+81-3-{a}-{b}"])
    if kind == 8:
        return r.choice(["({}) {}-{}", "{}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(r.choice(["02", "031", "051", "064", "042"]), a[: r.choice([3, 4])], b)
    if kind == 9:
        says = r.choice(_SPOKEN)
        spoken = "".join(says[int(c)] for c in a + b)
        return f"공일공{r.choice('- ')}{spoken[:4]}{r.choice('- ')}{spoken[4:]}"
    return f"{r.choice(['02', '031', '051'])}-{a[:3]}-{b}"


def _id_number(r: random.Random) -> str:
    born = _digits(r, 2) + f"{r.randint(1, 12):02}{r.randint(1, 28):02}"
    rest = r.choice("12345678") + _digits(r, 6)
    kind = r.random()
    if kind < 0.75:
        return born + r.choice(["-", "-", "-", " ", " - ", "–", "", "."]) + rest
    if kind < 0.88:
        return f"{r.choice(['666', '900', _digits(r, 3)])}-{_digits(r, 2)}-{_digits(r, 4)}"
    return f"{r.randint(11, 99)}-{_digits(r, 2)}-{_digits(r, 6)}-{_digits(r, 2)}"


def _address(r: random.Random) -> str:
    kind, n = r.random(), str(r.randint(1, 990))
    if kind < 0.25:
        street, town = r.choice(_STREETS), r.choice(_TOWNS) if r.random() < 0.6 else " ".join(_invented(r, r.choice([1, 2])) for _ in range(r.choice([1, 2, 2])))
        return r.choice([f"{n} {street}, {town}", f"Flat {r.randint(1, 40)}, {n} {street}, {town}", f"{n}B {street}, Apt {r.randint(1, 40)}, {town}"])
    if kind < 0.5:
        lot = r.choice(["", "산 "]) + n + r.choice(["", "-" + _digits(r, 1)]) + r.choice(["번지", ""])
        return f"{r.choice(_DO)} {r.choice(_GUN)} {r.choice(_MYEON)} {r.choice(_RI)} {lot}"
    if kind < 0.62:
        return f"{r.choice(_SI)} {r.choice(['', r.choice(_GU) + ' '])}{r.choice(_DONG)} {n}-{_digits(r, 2)}{r.choice(['번지', ''])}"
    side = r.choice(["", "", f"{r.randint(2, 60)}번길"])
    tail = r.choice(["", "", f", {r.randint(101, 120)}동 {r.randint(101, 1900)}호", f" {r.randint(1, 12)}층", f", {r.randint(101, 900)}호"])
    return f"{r.choice(_SI)} {r.choice(_GU)} {r.choice(_ROADS)}{side} {n}{r.choice(['', '-' + _digits(r, 2)])}{tail}"


_MAKE = {"name": _name, "known": _western, "korean": _korean, "email": _email, "phone": _phone, "id_number": _id_number, "address": _address}


def made_up(n: int = SENTENCES, seed: int = 11) -> list[tuple[str, set[tuple[int, int, str]]]]:
    """Short texts with their entities (start, end, type): what the model is fitted on. Frames and values are general ones written for this
    purpose, names and odd words come in part from random syllables."""
    r = random.Random(seed)
    with_, without = ([x for x in re.split(r"(?<=\S)\|(?=\S)|\n", frames) if x] for frames in (_WITH, _WITHOUT))
    out = []
    for _ in range(n):
        text, gold = "", set()
        for k in range(r.choice([1, 1, 2, 2, 3])):
            text += r.choice(["", "", "", "# ", "<p>", "- ", "ㅎㅎ "]) if not k else r.choice([" ", " ", "\n", "\n\n", ". ", "</p><p>"])
            text = _filled(r.choice(with_ if r.random() < 0.5 else without), text, gold, r)
        out.append((text + r.choice(["", "", ".", "\n", "</p>"]), gold))
    return out


_SLOT = re.compile(r"(<(?:name|known|korean|email|phone|id_number|address)>|\{[A-Za-z_]+\d?\})")


def _filled(frame: str, text: str, gold: set[tuple[int, int, str]], r: random.Random) -> str:
    for part in _SLOT.split(frame.replace("\\n", "\n")):
        slot = part[1:-1]
        if part[:1] == "<" and slot in _MAKE:
            value = _MAKE[slot](r)
            gold.add((len(text), len(text) + len(value), "name" if slot in ("known", "korean") else slot))
            text += value
        elif part[:1] == "{" and _SLOT.fullmatch(part):
            text += _filler(slot, r)
        else:
            text += part
    return text


def _filler(slot: str, r: random.Random) -> str:
    if slot[0] == "n" and slot[1:].isdigit():
        return _digits(r, int(slot[1:]))
    if slot == "id":
        return _digits(r, 2)
    if slot == "sino":  # three syllables as ordinary words are made of
        return r.choice(SURNAMES) + r.choice(_COMMON_SYLLABLES) + r.choice(_COMMON_SYLLABLES)
    if slot == "odd":  # an odd Korean name of a body or place
        word = "".join(_syllable(r) if r.random() < 0.5 else r.choice(_GIVEN_ONE + _GIVEN_TWO) for _ in range(r.choice([2, 3, 3, 4])))
        return word + r.choice(["", "", "협회", "마을", "연구소", "모임", "회", "재", "원"])
    if slot == "place":
        word = _invented(r, r.choice([2, 2, 3])) if r.random() < 0.6 else r.choice(_ENGLISH_WORDS)
        return r.choice([f"{word} {r.choice(_PLACE_ENDS)}", f"{word} {r.choice(_PLACE_ENDS)}", f"{word} {_invented(r, 2)}", word, f"{r.choice(_ENGLISH_WORDS)} {word}"])
    if slot == "thing_name":
        return " ".join(_invented(r, r.choice([2, 3])) for _ in range(r.choice([1, 2, 2])))
    if slot == "heading":
        return " ".join(r.choice(_ENGLISH_WORDS + _PLACE_ENDS) for _ in range(r.choice([2, 2, 3, 4])))
    if slot == "WORDS":
        return " ".join(r.choice(_ENGLISH_WORDS) for _ in range(2)).upper()
    if slot in ("Camel", "camel"):
        word = "".join(r.choice(_ENGLISH_NOUNS).capitalize() for _ in range(r.choice([1, 2])))
        return word if slot == "Camel" else word[0].lower() + word[1:]
    if slot == "erole":
        word = r.choice(_ROLES_EN)
        return r.choice([word, word.capitalize(), word.capitalize(), word + r.choice([":", ""])])
    return r.choice({
        "role": _ROLES_KO, "label": _LABELS_KO, "elabel": _LABELS_EN, "hon": HONORIFICS, "title": TITLES, "noun": _NOUNS, "verb": _VERBS, "thing": _THINGS, "when": _WHEN, "p": _PARTICLE, "o": ["을", "를"], "enoun": _ENGLISH_NOUNS, "everb": _PERSON_VERBS,
        "everb2": _BODY_VERBS, "c": _COMMON, "word": _ENGLISH_WORDS, "kind": _KINDS, "ekind": _KINDS_EN, "road": _ROADS, "si": _SI, "gu": _GU, "street": _STREETS, "town": _TOWNS, "fam": SURNAMES[:30],
    }[slot])


@functools.cache
def fitted(n: int = SENTENCES) -> SemiMarkov:
    """The model, fitted on n made-up texts; the same on every machine."""
    examples = []
    for text, gold in made_up(n):
        examples.append((list(dict.fromkeys(candidates(view(text).text))), gold))
    model = SemiMarkov().fit(examples)
    model.weights = {f: round(w, 4) for f, w in model.weights.items() if abs(w) > 0.02}
    return model


# ---- texts ----------------------------------------------------------------------------------------------------------------


def entities(model: SemiMarkov, text: str) -> list[tuple[str, int, int]]:
    """(type, start, end) of the entities of a text, in order, without overlaps; places count code points of the stored text."""
    if not text:
        return []
    seen = view(text)
    out, end = [], 0
    for s in model.best(candidates(seen.text)):
        if s.start >= end:
            out.append((s.type, seen.at(s.start), seen.at(s.end)))
            end = s.end
    return out


_SPANS = pa.list_(pa.struct([("pii_type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))


def _find(model: SemiMarkov, redact: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, texts, keep = [], [], []
        for k, cell in enumerate(batch.column(1)):
            text = cell.as_py()
            found = entities(model, text) if text else []
            if not found and not redact:
                continue
            keep.append(k)
            spans.append([{"pii_type": t, "start": a, "end": b, "value": text[a:b]} for t, a, b in found])
            if redact:
                parts, at = [], 0
                for t, a, b in found:
                    parts += [text[at:a], PLACEHOLDER[t]]
                    at = b
                texts.append(None if text is None else "".join(parts) + text[at:])
        ids = batch.column(0).take(pa.array(keep, pa.int64())).cast(pa.int64())
        columns = [ids, pa.array(spans, _SPANS)] + ([pa.array(texts, pa.string())] if redact else [])
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "spans", "text"][: len(columns)])


_SCHEMA = "doc_id bigint, spans array<struct<pii_type: string, start: int, end: int, value: string>>"


def redacted(documents: DataFrame, sentences: int = SENTENCES) -> DataFrame:
    """(doc_id, spans, text): every row of documents, its personal information and its text with typed placeholders.

    Everything outside the spans is unchanged. Null texts stay null, empty ones empty, both without spans; repeated rows and null
    ids stay; texts of any length are read whole; an empty table gives an empty result.
    """
    model = fitted(sentences)
    return spread(documents.select("doc_id", "text")).mapInArrow(lambda b: _find(model, True, b), _SCHEMA + ", text string")


def personal_values(documents: DataFrame, sentences: int = SENTENCES) -> DataFrame:
    """(doc_id, pii_type, value): one row per document, type and distinct value, by the same model as ``redacted``."""
    model = fitted(sentences)
    found = spread(documents.select("doc_id", "text").where("text is not null")).mapInArrow(lambda b: _find(model, False, b), _SCHEMA)
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.pii_type", "s.value").distinct()


def type_counts(documents: DataFrame) -> DataFrame:
    """(pii_type, spans, documents) over the corpus; types that do not occur are counted too, as 0."""
    found = redacted(documents).select("doc_id", F.explode("spans.pii_type").alias("pii_type"))
    counted = found.groupBy("pii_type").agg(F.count("*").alias("spans"), F.countDistinct("doc_id").alias("documents"))
    every = documents.sparkSession.createDataFrame([(t,) for t in TYPES], "pii_type string")
    return every.join(counted, "pii_type", "left").na.fill(0)
