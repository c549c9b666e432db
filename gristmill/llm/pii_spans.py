"""Candidate spans of personal information and their features.

Offsets: patterns run on a *view* of the text, in which full-width characters, dashes and spaces have their plain form and
decomposed letters are composed; ``View.at`` leads every place of the view back to the stored text.
"""

from __future__ import annotations

import functools
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

TYPES = ("email", "phone", "id_number", "address", "name")

# ---- view -----------------------------------------------------------------------------------------------------------------

_PLAIN = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
_PLAIN |= dict.fromkeys([0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2015, 0x2212, 0xFE58, 0xFE63, 0x30FC, 0x2043], ord("-"))
_PLAIN |= dict.fromkeys([0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 0x09, 0x0B, 0x0C], ord(" "))
_PLAIN |= {0x2018: ord("'"), 0x2019: ord("'"), 0x2024: ord("."), 0x3002: ord("."), 0x00B7: ord(".")}
_ODD = re.compile("[" + "".join(map(chr, sorted(_PLAIN))).replace("\t", r"\t").replace("\x0b", r"\x0b").replace("\x0c", r"\x0c") + "]")


class View(NamedTuple):
    text: str
    places: list[int] | None  # place in the stored text of each place of the view; None: the same

    def at(self, place: int) -> int:
        return place if self.places is None else self.places[place]


def view(text: str) -> View:
    places = None
    if not text.isascii():
        if not unicodedata.is_normalized("NFC", text):
            parts, places, i = [], [], 0
            while i < len(text):
                j = i + 1
                while j < len(text) and (unicodedata.combining(text[j]) or "ᅠ" <= text[j] <= "ᇿ"):
                    j += 1
                part = unicodedata.normalize("NFC", text[i:j])
                parts.append(part)
                places += [i] * len(part)
                i = j
            text = "".join(parts)
            places.append(i)
        if _ODD.search(text):
            text = text.translate(_PLAIN)
    return View(text, places)


# ---- words -----------------------------------------------------------------------------------------------------------------

#: What a person is called by in front of a name: roles, titles, labels. General vocabulary; the model learns what each kind is worth.
ROLES = set(
    "담당자 담당 작성자 작성 신청인 신청자 접수자 접수인 민원인 목격자 증인 수신인 발신인 수취인 보낸이 받는이 사람 예금주 입금자 대표자 대표 대표이사 사장 환자 보호자 고객 회원 저자 지은이 글쓴이 필자 옮긴이 번역 글 그림 사진 "
    "제공은 문의 피해자 피고인 피의자 원고 참고인 의뢰인 계약자 임차인 임대인 학생 교사 원장 기자 연구자 연구원 책임자 관리자 가입자 예약자 당첨자 수상자 참석 참석자 참가자 발표자 진행자 운전자 승객 배우 가수 감독 작가 시인 화가 선수 코치 "
    "총무 반장 의사 간호사 교수 박사 변호사 판사 검사 형사 목사 신부 스님 어머니 아버지 아들 딸 동생 누나 언니 오빠 형 남편 아내 친구 이웃 심사위원 위원 이사 주연 조연 고 편집 취재 발신 수신 참조 "
    "author maintainer contact signed attn applicant patient customer user owner witness member reviewer manager sender recipient signatory contributor reporter editor translator tenant buyer seller professor captain judge mayor nurse chairman chairwoman president director minister secretary "
    "sergeant detective senator president brother sister son daughter wife husband neighbour friend colleague winner by mr mrs ms miss dr prof sir cc from to dear ask regards sincerely yours cheers best thanks lists called named".split()
)
LABELS = set("성명 이름 성함 회원명 고객명 환자명 입금자명 예금주명 수취인명 신청인명 담당자명 작성자명 회원정보 name fullname owner_name username author_name".split())
#: What follows a name, as a word or part of one.
HONORIFICS = "씨 님 군 양 선생님 선생 기자 교수 박사 과장 팀장 부장 대리 사원 주임 차장 실장 귀하 올림 드림 배상 진술 여사".split()
#: Of what follows too, but also stands by itself.
TITLES = "원장 대표 이사 위원 의원 변호사 간사 학생 회원 작가 감독 선수 사장 회장 장관 시장 목사 형사 판사".split()
AFTER = set(HONORIFICS) | set("tel phone mobile mail email the id ssn ph living who whose jr sr phd md esq".split())
_PARTICLES = "의 은 는 이 가 을 를 에게 에게서 께 께서 께서는 과 와 도 한테 한테서 만 까지 처럼 보다 이라는 라는 이라고 라고 이라고는 이라면 이다 다 입니다 이에요 예요 이며 며 이고 고 이었다 였다 인 이랑 랑 이든 에 으로 로 이나 나 마저 조차 뿐 들 측 네 이야 야 아".split()
#: Honorifics that are written to the name without a space.
_HONORED = tuple(HONORIFICS[:12])
_SUFFIXES = set(_PARTICLES) | {h + p for h in _HONORED for p in ["", *_PARTICLES]}
#: Words of numbers that are nobody's.
NOBODYS = set("일련번호 관리번호 문서번호 순번 판본 버전 품번 부품번호 제품번호 모델 모델명 송장 운송장 주문번호 측정값 기간 사건번호 접수번호 등록상표 사업자등록번호 계좌번호 우편번호 version serial part invoice order build isbn issn model revision item ip".split())
SURNAMES = (
    "김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 류 유 전 홍 고 문 양 손 배 백 허 남 심 노 나 하 곽 성 차 주 우 구 민 진 지 엄 채 원 천 방 공 현 함 변 염 여 추 도 소 석 선 설 마 길 연 위 표 명 기 반 라 왕 금 옥 육 인 맹 제 모 탁 국 어 은 편 용 예 봉 사 부 복 태 목 형 피 감 음 빈 동 온 호 범 좌 팽 승 간 상 시 갈 단 견 당 계 경"
).split()
LONG_SURNAMES = "남궁 황보 제갈 사공 선우 서문 독고 동방 망절".split()
#: Syllables that given names often have in the first and in the second place.
GIVEN_ONE = set("민서지현준우수영은혜예태성재동원정경미상진윤소유채승기하도시나다가보선세연주희명병종철광용인규남춘순옥말해라아효슬찬건한새봄문흥본요학필형호화덕두복완운웅조창홍환훈향범석강근금란무백설산여일장초치탁길")
GIVEN_TWO = set("준서민현우수영은혜호진희연아빈석철훈경숙자원윤지하나라주미정선화순옥식구규만환찬혁욱엽겸율린솔별늘람휘성태재섭범권률온결국길근문필학한애용택덕모엘슬담돌동명백빛심양월종중창탁향헌형홍후유인롬름")
#: Given names whose second syllable ends many ordinary words.
GIVEN_WHOLE = set("슬기 유리 규리 나리 혜리 미리 애리 주리 보리 두리 예리 채리 소리 새미 세라 유라 보라".split())
#: Last words of bodies and places that look like names.
BODIES = set(
    "institute hall works society valley university college school company inc ltd corp group bank museum press house park street road lane avenue way drive bay beach island islands mountains mountain hills hill forest garden gardens square tower gate castle palace airport "
    "station bridge city town county river lake sea ocean hotel hospital church center centre committee council agency office foundation association union party league club team project system war day year street market theatre theater library academy army airlines award cup festival "
    "service services support learning science language law act code page report street north south east west state states nations kingdom republic".split()
)
#: Of them, those that end no person's name.
NOBODY_ENDS = set("institute works society valley university college school company inc ltd corp museum hospital committee council agency office foundation association union project system team service services support states nations republic avenue street road airport".split())
#: Words that are in capitals for other reasons than being a name.
_NO_NAME = set(
    "the a an of and or in on at for with to from by this that these those it its he she we they you i is are was were be been if when while as but not no yes so then than there here what which who whose how why where please dear contact ask call signed author name mr mrs ms miss dr prof professor "
    "sincerely regards yours best cheers thanks thank tel phone email mail id ssn address monday tuesday wednesday thursday friday saturday sunday january february march july august september october november december after before according unlike each every both between add see about even although "
    "because since until under over into photo translated written reported reviewed filed meet interview questions captain nurse judge mayor her his my our their your yesterday today tomorrow once later yes never always often perhaps however meanwhile whenever did does do has have had would could chairman chairwoman president director minister next last every some many another only also again still just use".split()
)
#: Ordinary English words that titles, places and products are made of.
_ORDINARY = set(
    "new old great little big happy central golden blue red green black white grand royal national international united general public first second third good free open long short high low upper lower north south east west northern southern eastern western lake mount river port fort san santa los las saint st "
    "machine deep data error page not found chapter part section version terms privacy order customer user system file time year day night morning evening winter summer spring autumn music art book story song house home world country state city power water fire air road street school office market food "
    "health care news sports science history English French German Spanish Korean Chinese Japanese American British European select from where group order class public static return string int void import export function true false null none".lower().split()
)
#: Given names and family names that are common in several countries.
GIVEN = set(
    "james mary john patricia robert jennifer michael linda david elizabeth william barbara richard susan joseph jessica thomas sarah charles karen christopher lisa daniel nancy matthew anthony margaret mark sandra donald ashley steven paul emily andrew joshua kenneth michelle kevin amanda brian george melissa "
    "edward rebecca ronald laura timothy cynthia jason kathleen jeffrey amy ryan anna jacob shirley gary angela nicholas helen eric jonathan stephen larry nicole justin scott brandon frank benjamin gregory samuel raymond patrick alexander jack dennis henry alice peter rachel walter ethan jeremy carl "
    "arthur maria carlos juan jose luis ana sofia elena marco luca giulia pierre jean marie claire hans klaus anna ingrid lars sven olga ivan dmitri natalia pavel jan piotr ahmed mohammed fatima ali omar leila priya raj amit ananya kenji yuki hiroshi sakura wei li min mei "
    "oliver jake noah grace lily sophie emma chloe lucas leo max oscar felix hugo nora eva julia martin victor simon adam".split()
)
FAMILY = set(
    "smith johnson williams brown jones garcia miller davis rodriguez martinez hernandez lopez gonzalez wilson anderson thomas taylor moore jackson martin lee perez thompson white harris sanchez clark ramirez lewis robinson walker young allen king wright scott torres nguyen flores green adams nelson baker "
    "rivera campbell mitchell carter roberts kim park choi jung kang cho yoon jang lim muller schmidt schneider fischer weber meyer wagner rossi russo ferrari bianchi silva santos ivanov petrov novak kowalski nowak jansen andersson hansen larsen nielsen tanaka suzuki sato watanabe wang zhang chen liu singh sharma patel khan ali hassan cohen".split()
)
#: Of them, those of the most frequent names.
_MOST_ONE, _MOST_TWO = set("서지민하예윤도준수유은주우채시현혜정소보나재성승"), set("준서윤우연은현진희영지아빈린민율원훈호나라")
#: Ordinary Korean words that begin like a name: of two syllables, which a particle may follow, and of three.
_WORDS_TWO = (
    "정부 정책 정보 정리 정도 정상 정확 정치 정지 정신 정원 정답 조사 조건 조금 조직 조정 조회 조선 조용 이유 이번 이전 이후 이상 이미 이것 이런 이제 이미 이용 이사 이민 이론 이름 이야 이때 이곳 이웃 이익 이불 이해 주민 주소 주문 주장 주제 주말 주식 주차 주인 주변 주로 주의 주요 "
    "시장 시간 시작 시험 시민 시설 시대 시절 시스 고객 고양 고민 고장 고기 고향 고급 고속 고려 전화 전체 전기 전국 전문 전통 전자 전시 전쟁 전부 전혀 전에 안내 안전 안개 안경 안정 안에 지역 지금 지난 지도 지원 지급 지수 지식 지구 지방 지하 지점 지시 지켜 국가 국민 국어 국내 국제 "
    "서울 서로 서비 서류 서쪽 서민 서점 한국 한글 한번 한편 한참 한강 한데 최근 최고 최대 최소 최초 최종 강아 강의 강조 강제 강남 강력 장소 장마 장비 장난 장면 장점 임대 임금 임시 임무 오늘 오후 오전 오래 오류 오히 신문 신청 신고 신호 신발 신입 신용 문제 문화 문서 문의 문장 문자 "
    "방법 방송 방향 방문 방식 방학 공사 공원 공부 공장 공기 공간 공연 공개 구조 구성 구매 구간 구름 구분 기록 기술 기관 기본 기준 기능 기업 기간 기온 기차 여행 여러 여름 여자 여전 여기 여부 우리 우선 우수 우산 우유 우편 유지 유리 유일 유명 유형 연구 연락 연결 연습 연말 연도 사람 사용 사업 사회 사실 사진 사이 사고 사례 "
    "도시 도로 도움 도서 도구 도착 소리 소식 소개 소설 소비 소년 성과 성공 성격 성인 성장 배경 배달 배우 배송 백화 손님 손해 홍보 홍수 황금 남쪽 남자 남은 남편 노력 노인 노래 노동 노트 하루 하나 하지 하늘 하천 하면 하는 허가 허용 심사 심리 심각 차이 차량 차례 차츰 민원 민족 민간 진행 진단 진짜 진료 현재 현장 현금 현대 현실 "
    "원인 원래 원칙 원고 천천 천장 천둥 함께 함수 변화 변경 변수 추가 추천 추진 추석 석유 선택 선생 선거 선수 설명 설치 설정 마을 마음 마지 마감 마당 위치 위험 위원 위해 표현 표시 표준 명령 명절 반응 반복 반대 반면 라면 왕국 금액 금지 금융 인구 인간 인기 인터 제도 제품 제출 제목 제안 모임 모두 모든 모델 어제 어떤 어디 "
    "은행 용도 용어 예산 예약 예상 예술 예정 부분 부족 부모 부산 복잡 복사 태도 태풍 목적 목록 형태 형식 피해 감독 감사 감소 음식 음악 빈도 동안 동네 동물 동일 온도 온라 호텔 범위 승인 승객 간단 간격 상황 상태 상품 상담 단계 단어 단체 당시 당일 계획 계산 계약 계절 경제 경우 경험 경기 경찰 경로 길이 양식 양쪽 윤리 권리 권한 소유 심전 송금 송신 유적 채널 채용 엄격 봉투 부품"
).split()
_WORDS_THREE = (
    "하지만 이야기 고양이 강아지 지하철 도서관 박물관 자동차 전시회 기념일 신청서 계약서 안내문 이메일 고객센터 지원자 주인공 위원회 한국어 유치원 고등학 초등학 노트북 서비스 시스템 이용자 정류장 정거장 주차장 공무원 연구소 연구원 사무실 사업자 사용자 소비자 전문가 어머니 선생님 여러분 여름철 현대인 민주화 경찰서 장학금 제주도 전라도 강원도 경기도 인터넷 오랫동 이번에 "
    "하늘색 유리창 강의실 남대문 조선시 세종대 문화재 원자재 구청장 시청자 신호등 심사평 방송국 안경점 임대료 장마철 노인정 금요일 목요일 수요일 일요일 토요일 오징어 고구마 지우개 사다리 기러기 현미경 망원경 내시경 안경점 진동수 주파수 원동기 천문대 방문자 공연장 변호인 여론조 추진력 소방서 석유화 선진국 설명서 마라톤 원소기 두루미 이파리 배드민 우체국 어린이 한가운 마찬가 오늘날 이처럼 그러나 그리고 하여금 도대체 어쨌든"
).split()
ORDINARY_KO = set(_WORDS_TWO) | set(_WORDS_THREE)

#: More names, which the model meets in training as ones that it does not know.
MORE_NAMES = set(
    "abigail adele agnes albert alfred allison angelo audrey barry bernard bertha bradley brenda bruno calvin camille carmen caroline cecilia chester clara clarence clifford connor craig crystal curtis dean debbie denise dominic donna doris dorothy douglas dustin edgar eileen eleanor ella ellen elliot ernest ethel eugenia "
    "felicity fiona frances frederick gavin geoffrey gerald gilbert gina gladys gordon greta harold harvey hazel herbert howard hubert irene irma ivy jasmine jerome jill joanna jocelyn joyce june katrina keith kirsten kurt lena leonard leslie lester lorraine lucille lydia mabel marcel marian marvin maureen maurice mildred "
    "milton molly muriel myra nadia neil nelson nina norman olive oswald pamela paula pauline penelope perry rafael ramon regina rita roger roland rosemary ross rufus sabrina seth sheila sidney stanley stella sylvia tanya theodore tina tracy ursula valerie vera vernon violet virginia wallace wanda warren wendy wilma winifred "
    "abbott armstrong atkins austin bailey baldwin barnes barton bates beck becker berg bishop blake bowman bradford brooks bryant buckley burke burton byrne cameron carlson carr chambers chandler chapman clayton coleman collins conway cooper craft crane crosby cunningham dalton davidson dawson dempsey dickson donovan douglas "
    "drake duncan eaton elliott emerson erickson farmer farrell fleming fletcher foster fowler franklin frost gallagher gardner garrett gilmore goodman gould greene griffith hale hammond hancock hansen harding harper harrington hart haynes henderson higgins hobbs hoffman holland hopkins houston howell hubbard hudson ingram "
    "jacobs jennings jenkins johnston keller kelley kirby lambert lancaster larson lawrence lawson leonard lindsay logan lowe lynch maddox malone manning marsh mathews maxwell mccarthy mckinney meadows merritt monroe montgomery moran morgan morris moss mueller newton norris obrien parker parsons patterson payne pearson perkins "
    "peters phillips pierce pope powell pratt preston quinn ramsey randall reed rhodes richards riley robbins rowe ryan sanders saunders sawyer schultz sharp shelton sherman simmons skinner snyder spencer stanton stephens stewart strickland summers sutton swanson tate thornton todd townsend travis turner underwood vance vaughn "
    "wade wagner walsh walters watkins watson weaver weiss whitaker whitney wilkins wolfe woodward wyatt yates zimmerman".split()
)

# ---- candidates -----------------------------------------------------------------------------------------------------------


class Span(NamedTuple):
    start: int
    end: int
    type: str
    features: tuple[str, ...]


_D = "[공영일이삼사오육칠팔구]"
_P = r"(?: ?[-.] ?| )"  # between the groups of a number
_PHONES = [
    ("intl_kr", rf"\+\s?82{_P}?\(0\){_P}?\d{{1,2}}{_P}?\d{{3,4}}{_P}?\d{{4}}|\+\s?82{_P}?\d{{1,2}}{_P}?\d{{3,4}}{_P}?\d{{4}}"),
    ("intl_us", rf"\+\s?1{_P}?\(?\d{{3}}\)?{_P}?\d{{3}}{_P}?\d{{4}}"),
    ("intl", rf"\+\s?\d{{1,3}}(?:{_P}?\(?\d{{1,4}}\)?){{2,5}}"),
    ("exit", rf"00\d{{1,3}}{_P}\d{{1,3}}{_P}\d{{1,4}}{_P}\d{{3,4}}{_P}\d{{4}}"),
    ("bare_kr", rf"82{_P}10{_P}\d{{3,4}}{_P}\d{{4}}"),
    ("bracket", rf"\(\s?\d{{2,4}}\s?\){_P}?\d{{3,4}}{_P}\d{{4}}"),
    ("half", rf"0\d{{1,2}}\){_P}?\d{{3,4}}{_P}\d{{4}}"),
    ("mobile", rf"01[016789]{_P}\d{{3,4}}{_P}\d{{4}}"),
    ("mobile_plain", r"01[016789]\d{7,8}"),
    ("mobile_half", rf"01[016789]{_P}\d{{7,8}}|01[016789]\d{{3,4}}{_P}\d{{4}}"),
    ("area", rf"0\d{{1,2}}{_P}\d{{3,4}}{_P}\d{{4}}"),
    ("us", rf"\d{{3}}{_P}\d{{3}}{_P}\d{{4}}"),
    ("spoken", rf"[공영] ?일 ?{_D}{_P}?(?:{_D} ?){{3,4}}{_P}?(?:{_D} ?){{3}}{_D}|[공영]{_D}{{1,2}}{_P}{_D}{{3,4}}{_P}{_D}{{4}}"),
    ("mixed", rf"01[016789]{_P}{_D}{{3,4}}{_P}{_D}{{4}}"),
    ("personal", rf"050\d{_P}\d{{3,4}}{_P}\d{{4}}"),
    ("service", r"1[568]\d\d-\d{4}"),
]
_PHONE = re.compile(r"(?<![\d\w])(?<!\d[-.])(?:" + "|".join(f"(?P<{n}>{p})" for n, p in _PHONES) + r")(?![\d])(?!-\d)(?!\.\d)")
_IDS = [
    ("resident", r"\d{6} ?[-./~] ?\d{7}"),
    ("resident_space", r"\d{6} {1,2}\d{7}"),
    ("resident_plain", r"\d{13}"),
    ("ssn", r"\d{3} ?[-.] ?\d{2} ?[-.] ?\d{4}"),
    ("ssn_space", r"\d{3} \d{2} \d{4}"),
    ("licence", r"\d{2} ?[-.] ?\d{2} ?[-.] ?\d{6} ?[-.] ?\d{2}"),
    ("licence_space", r"\d{2} \d{2} \d{6} \d{2}"),
]
_DIGIT = re.compile(r"\d|[공영일][공영일이삼사오육칠팔구]")
_LONG_NUMBER = re.compile(r"\d[\d\-./~ ()]{6}|[공영] ?일|[공영][공영일이삼사오육칠팔구]{1,2}[\- .]")
_SIGN_OF_MAIL = re.compile(r"@|골뱅이|[앳엣] |[\[({] ?(?:at|AT)|(?:at|AT) [A-Za-z0-9\-]+(?: (?:dot|DOT|점|닷|쩜) |\.[A-Za-z]{2})")
_ID = re.compile(r"(?<![\d\w])(?<!\d[-.])(?:" + "|".join(f"(?P<{n}>{p})" for n, p in _IDS) + r")(?![\dA-Za-z])(?!-\d)")
_AT = re.compile(r" ?@ ?| ?[\[({] ?(?:at|AT|골뱅이) ?[\])}] ?| ?골뱅이 ?| (?:at|AT|앳|엣) (?=[A-Za-z0-9\-]+(?: (?:dot|DOT|점|닷|쩜) |\.[A-Za-z]{2}))")
_LOCAL = re.compile(r"[A-Za-z0-9가-힣_](?:[A-Za-z0-9가-힣_.+\-%']*[A-Za-z0-9가-힣_+\-])?$")
_DOT = r"(?:\.| ?[\[({] ?(?:\.|dot|DOT|점|닷|쩜) ?[\])}] ?| (?:dot|DOT|닷|점|쩜) )"
_LABEL = r"(?:[A-Za-z0-9](?:[A-Za-z0-9\-]*[A-Za-z0-9])?|[가-힣]+)"
_DOMAIN = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})+")
_UNIT = re.compile(r"[가-힣0-9.]{1,11}?(특별시|광역시|특별자치시|특별자치도|시|도|군|구|읍|면|동|리|(?<=\d)가|로|길)")
_LOT = re.compile(r"(?<=[로길동리가읍면])(?: ?\d+(?:번)?[가나다라]?길)?(?: (?:산 ?)?\d{1,5}(?:-\d{1,4})?(?! ?(?:번째|년|월|일|km|개|%|명|번 ))(?!\d)(?:번지)?(?:의 ?\d+)?)")
_LOT_TAIL = re.compile(r"(?:,? ?[가-힣A-Za-z]{2,10}(?:아파트|빌딩|빌라|타워|오피스텔|맨션|빌))?(?:,? ?(?:제 ?)?\d{1,4}동)?(?:,? ?(?:제 ?)?[B지]?\d{1,5}호)?(?:,? ?(?:지하 ?)?B?\d{1,3}층)?(?: ?\d{1,5}호)?")
_ENGLISH = re.compile(
    r"(?<![\w\-])(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.? ?#?\d+[A-Z]?, ?)?\d{1,5}[A-Z]?(?:-\d+)? (?:[A-Z][a-z']+\.? ){1,4}?"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Way|Court|Ct|Place|Pl|Boulevard|Blvd|Terrace|Close|Square|Crescent|Hill|Row|Walk|Mews|Grove|Gardens|Parade|Highway|ro|gil)\b\.?"
    r"(?:,? (?:Flat|Apt|Apartment|Unit|Suite|Room|Floor|#)\.? ?#?\d+[A-Z]?)?(?:,? \d+(?:st|nd|rd|th) [Ff]loor)?"
)
_TOWN = re.compile(r", ([A-Z][a-z]+)((?:[ -][A-Z][a-z]+){0,2})")
_UP, _LOW = ("".join(c for c in map(chr, range(0x41, 0x530)) if t(c)) for t in (str.isupper, str.islower))
#: A Hangul word that begins with a family name, or a family name by itself and the word after it.
_KOREAN = re.compile(rf"(?<![가-힣])(?:(?:{'|'.join(LONG_SURNAMES)}|[{''.join(SURNAMES)}]) (?=[가-힣]{{2}})|[{''.join(sorted({x[0] for x in [*SURNAMES, *LONG_SURNAMES]}))}])[가-힣]+")
_CAPITAL = rf"[{_UP}][{_UP}{_LOW}]*(?:['-](?![sS]\b)[{_UP}{_LOW}]+)*"
_CONNECT = r"(?:de|del|della|di|da|dos|van|von|der|den|la|le|el|bin|ibn|y)"
#: Words in capitals in a row, with initials and the small words that names have.
_RUN = re.compile(rf"(?<![\w\-@.])(?<!\w')(?:[{_UP}]\.|{_CAPITAL})(?: (?:[{_UP}]\.|{_CAPITAL}(?![A-Za-z0-9_@À-ɏ])|{_CONNECT}(?= [{_UP}a-z])))+")
_COMMA = re.compile(rf"(?<![\w\-@.])({_CAPITAL}), ({_CAPITAL})((?: [{_UP}]\.)?)(?![\w\-@])")
_PIECE = re.compile(r"[^ ]+")
_BACK = re.compile(rf"([{_UP}{_LOW}]+|[가-힣]+)([^{_UP}{_LOW}가-힣]*)$")
_FORTH = re.compile(rf"([^{_UP}{_LOW}가-힣]*)([{_UP}{_LOW}]+|[가-힣]+)")
_PARTICLE = re.compile(r"(?:의|은|는|이|가|을|를|에게|께|께서|과|와|도|로|으로|명)$")
#: How far an entity reaches to either side for its context.
SIDE = 24


def _context(text: str, start: int, end: int) -> list[str]:
    """What stands to either side: the nearest word, its class, and the signs between."""
    before, after = text[max(0, start - SIDE) : start], text[end : end + SIDE]
    left, right = _BACK.search(before), _FORTH.match(after)
    out = []
    if left:
        word, signs = left.group(1).lower(), left.group(2)
        line = "\n" in signs
        signs = "\n" if line else signs.replace(" ", "")[-2:]
        bare = _PARTICLE.sub("", word) or word
        kind = "label" if word in LABELS or bare in LABELS else "role" if word in ROLES or bare in ROLES else "nobodys" if word in NOBODYS or bare in NOBODYS else "capital" if left.group(1)[0].isupper() and word not in _NO_NAME else "word"
        out += [f"l={word}", f"ls={signs}", f"l:{kind}", f"l:{kind}{signs}", f"l:{kind},{bare != word}"]
    else:
        signs = before.replace(" ", "")[-2:]
        out += ["l:none", f"ls={signs}"]
    if right:
        word, signs = right.group(2).lower(), right.group(1)
        signs = "\n" if "\n" in signs else signs.replace(" ", "")[:2]
        kind = "after" if word in AFTER or word in _HONORED_WORDS else "title" if word in _TITLE_WORDS else "capital" if right.group(2)[0].isupper() else word[-2:] if word.isascii() else "word"
        out += [f"r={word}", f"rs={signs}", f"r:{kind}", f"r:{kind}{signs}"]
        if not signs and kind == "word" and (not right.group(1)):
            then = _NEXT.match(text, end + len(word)) if word == "의" else None
            out.append(f"r+{then.group(1) if then and then.group(1) in _BELONGINGS else word[:2]}")
    else:
        out += ["r:none", f"rs={after.replace(' ', '')[:2]}"]
    return out


def _span(text: str, start: int, end: int, type_: str, *features: str) -> Span:
    return Span(start, end, type_, tuple([f"{type_}|{f}" for f in ("bias", *features, *_context(text, start, end))]))


def candidates(text: str) -> list[Span]:
    """All candidate spans of a view, of every type, wherever they stand."""
    out = list(_numbers_and_mail(text))
    if not text.isascii():
        out += _korean_names(text)
    out += _western_names(text)
    return out


def _numbers_and_mail(text: str) -> Iterator[Span]:
    for m in _AT.finditer(text) if _SIGN_OF_MAIL.search(text) else ():
        local = _LOCAL.search(text, max(0, m.start() - 64), m.start())
        domain = _DOMAIN.match(text, m.end())
        if not local or not domain or local.end() != m.start():
            continue
        ends = [domain.end()]
        last = re.search(r"[가-힣]+$", domain.group())
        if last:
            ends += [domain.end() - k for k in (1, 2) if len(last.group()) > k]
        glue = m.group().strip().lower()
        for end in ends:
            top = re.search(r"[A-Za-z0-9\-]+$|[가-힣]+$", text[m.end() : end])
            cut = text[end : domain.end()]
            yield _span(text, local.start(), end, "email", f"glue={glue}", f"cut={cut}", f"top={top.group().lower() if top else ''}", "korean" if last else "ascii")
    if not _DIGIT.search(text):
        return
    long = _LONG_NUMBER.search(text)
    for m in _PHONE.finditer(text) if long else ():
        kind, digits = m.lastgroup, re.sub(r"\D", "", m.group())
        if kind == "intl" and not 8 <= len(digits) <= 15:
            continue
        yield _span(text, m.start(), m.end(), "phone", f"kind={kind}", f"digits={len(digits)}")
    for m in _ID.finditer(text) if long else ():
        kind, digits = m.lastgroup, re.sub(r"\D", "", m.group())
        dated = kind.startswith("resident") and "01" <= digits[2:4] <= "12" and "01" <= digits[4:6] <= "31" and digits[6] in "12345678"
        yield _span(text, m.start(), m.end(), "id_number", f"kind={kind}", f"dated={dated}" if kind.startswith("resident") else f"first={digits[0]}")
    for m in _LOT.finditer(text):
        if not _DIGIT.search(m.group()):
            continue
        tail = _LOT_TAIL.match(text, m.end()).end()
        starts, at = [], m.start()
        while True:
            space = text.rfind(" ", max(0, at - 12), at)
            word = space + 1 if space >= 0 else max(0, at - 12)
            while word < at and not "가" <= text[word] <= "힣":
                word += 1
            unit = _UNIT.fullmatch(text, word, at) if word < at else None
            if not unit:
                break
            starts.append((word, unit.group(1)))
            if space < 0:
                break
            at = space
        for n, (start, unit) in enumerate(starts, 1):
            more = n < len(starts)
            for end in {m.end(), tail}:
                yield _span(text, start, end, "address", f"units={min(n, 4)}", f"first={unit}", f"more={more}", f"first={unit},more={more}", f"tail={end == tail}", f"last={starts[0][1]}")
    for m in _ENGLISH.finditer(text):
        ends = [(m.end(), 0)]
        town = _TOWN.match(text, m.end())
        if town:
            ends.append((town.end(1), 1))
            for w in re.finditer(r"[ -][A-Z][a-z]+", town.group(2)):
                ends.append((town.start(2) + w.end(), ends[-1][1] + 1))
        for end, n in ends:
            yield _span(text, m.start(), end, "address", "english", f"town={n}", f"more={n + 1 < len(ends)}", f"town={n},more={end != ends[-1][0]}")


@functools.lru_cache(maxsize=200_000)
def _korean_cuts(word: str) -> list[tuple[int, bool, bool, bool, list[str]]]:
    """(length, whether it may be a name without a sign beside it, whether what follows in the word is one, whether a number or the like beside
    it is sign enough, features) of the names that a
    Hangul word may begin with; the rest of the word must be particles and the like. There may be a space after the family name."""
    space = " " in word
    family = next((f for f in LONG_SURNAMES if word.startswith(f) and len(word) > len(f)), None)
    out = []
    for f in dict.fromkeys([family or word[0], *([] if space else word[0])]):
        if f not in _FAMILIES:
            continue
        head = len(f) + space
        for given in (2, 1, 3):
            end = head + given
            if end > len(word) or given != 2 and space:
                continue
            rest = word[end:]
            if word[head:end] in _TITLED or rest and rest not in _SUFFIXES or any(end == e for e, *_ in out) or given == 3 and word[end - 2 : end] in _ENDINGS:
                continue
            honored, common = rest.startswith(_HONORED), f not in SURNAMES or SURNAMES.index(f) < COMMON
            plain = word.replace(" ", "")
            ordinary = not space and (plain[:2] in ORDINARY_KO or plain[:3] in ORDINARY_KO) or word[head:end] in ORDINARY_KO
            if given == 2 and not rest and word[end - 1] in "과는을를에의고":
                continue
            usual = given == 2 and (word[head] in GIVEN_ONE and word[head + 1] in GIVEN_TWO if common else word[head] in _MOST_ONE and word[head + 1] in _MOST_TWO)
            verb = word[end - 1] in "하되한된했" and bool(rest) and rest[0] in _VERBAL
            bare = usual and not (space or ordinary or verb or not rest and word[end - 1] in "은이가만도로나") or given == 1 and len(f) == 2
            features = ["korean", f"cut={len(f)}{given}", f"space={space}", f"family={f if common else 'rare'}", f"ordinary={ordinary}", f"verb={verb}", f"rest={rest}", f"honored={honored}"]
            if given == 2:
                one, two = word[head], word[head + 1]
                features += [f"one={one}", f"two={two}", f"given={one in GIVEN_ONE}{two in GIVEN_TWO}", f"two_particle={two in _PARTICLES},{bool(rest)}"]
            out.append((end, bare, honored, given == 2 or len(f) == 2, features))
    return out


#: Family names, from the most frequent, that a name without a sign beside it may have.
COMMON = 58
#: Syllables that make longer words of words.
_NOUN_ENDS = set("선권도장자기소학법실부서금사점관회국체표품물제적계감층차량비률역력값판론")
_TITLED = set(HONORIFICS) | set(TITLES)
#: What verbs go on with after 하 or 되.
_VERBAL = "였다며고는여이"
_TITLE_WORDS = {t + p for t in TITLES for p in ["", *_PARTICLES]}
_HONORED_WORDS = {h + p for h in HONORIFICS for p in ["", *_PARTICLES]}
#: What somebody has: after a name with 의.
_BELONGINGS = set("집 집은 주소 주소는 전화 전화는 번호 번호는 메일 메일은 연락처 연락처는 사무실 사무실은 자택 자택은 휴대폰 아들 딸 어머니 아버지 남편 아내".split())
#: Ends of words that are no ends of names.
_ENDINGS = set("자의 에서 에게 으로 까지 부터 이다 처럼 보다 하고 한다 진다 하는 하며 하면 되면 되는 된다 했다 였다 었다".split())
_FAMILIES = set(SURNAMES) | set(LONG_SURNAMES)
_NEXT = re.compile(r" ?([가-힣]+)")
_THEN = re.compile(r"[ ,(/|;:<\[]{0,3}(?:\(?\+?\d[\d)\-./ ]{5}|[A-Za-z0-9._%+\-]+ ?(?:@|[(\[{]?at| at |골뱅이)|[가-힣]+(?:시|도) [가-힣]+[시군구동읍면])")
_OPENING, _BETWEEN = "\"'(<[{/#*-", " :=|/(\"'[<{#*-\n"


def _signed(text: str, start: int, end: int, rest: int) -> int:
    """2 if a person is announced before start or honoured after rest, the end of the word; 1 if that is less certain, or if a number, an
    address or the like follows; else 0. ``end`` is that of the name."""
    found = 0
    side = text[max(0, start - 16) : start]
    left = side.rstrip(" :=|/(\"'[<{#*-,").rsplit(None, 1)
    if left:
        word = left[-1].lstrip(_OPENING).lower()
        if (word in ROLES or word in LABELS) and (word.isascii() or "," not in side[-3:]):
            return 2
        if word[-1:] in _SHORT and (word[:-1] in ROLES or word[:-1] in LABELS):
            found = 2 if word[:-1] in LABELS else 1
    after = text[rest : rest + 1]
    if after == " " or after == "\n":
        then = _NEXT.match(text, rest)
        word = then.group(1) if then else None
        if rest == end and word in _HONORED_WORDS or rest == end + 1 and text[end] == "의" and word in _BELONGINGS:
            return 2
        if rest == end and word in _TITLE_WORDS:
            found = 1
    return found or (1 if rest == end and after in " ,(/|;:<[" and _THEN.match(text, rest) else 0)


_SHORT = set("은는이가명")


def _korean_names(text: str) -> Iterator[Span]:
    for m in _KOREAN.finditer(text):
        for length, bare, honored, usual, features in _korean_cuts(m.group()):
            start, end = m.start(), m.start() + length
            signed = 2 if honored else _signed(text, start, end, m.end())
            if not (bare or signed > (not usual)):
                continue
            yield _span(text, start, end, "name", *features, f"signed={signed},bare={bare}", f"signed={signed},{features[4]}")


def _trigrams(name: str) -> list[str]:
    padded = f"^{name}$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


_listed = GIVEN | FAMILY | MORE_NAMES
_letters = Counter(t for n in _listed for t in _trigrams(n))
_pairs = Counter(t[:2] for n in _listed for t in _trigrams(n))
_ends = Counter(t[1:] for n in _listed for t in _trigrams(n))
_single = Counter(t[1] for n in _listed for t in _trigrams(n))


@functools.lru_cache(maxsize=100_000)
def _spelling(name: str) -> float:
    """How a word is spelled by an interpolated model of the letters of the lists: mean logarithm of each letter's chance after the two before it. A
    name of the lists does not count itself."""
    name = name.split("-")[0]
    own, parts, total = name in _listed, _trigrams(name), 0.0
    for t in parts:
        backed = (max(0, _ends[t[1:]] - own) + 0.5) / (max(0, _single[t[1]] - own) + 13)
        total += math.log((max(0, _letters[t] - own) + 4 * backed) / (max(0, _pairs[t[:2]] - own) + 4))
    return total / len(parts)


def _like(name: str) -> int:
    """0 to 3: the more, the more a word is spelled like a name."""
    spelled = _spelling(name)
    return (spelled > -3.4) + (spelled > -2.9) + (spelled > -2.4)


def _western(words: list[str], comma: bool) -> list[str]:
    names = [w.lower() for w in words if not w.endswith(".") and w[0].isupper()]
    first, last = (names[-1], names[0]) if comma else (names[0], names[-1])
    caps = all(w.isupper() for w in words)
    known = f"{first.split('-')[0] in GIVEN}{last in FAMILY}"
    turned = not comma and first in FAMILY and last not in FAMILY
    ordinary = min(2, sum(n in _ORDINARY for n in names))
    like, spelled = f"{_like(first)}{_like(last)}", round(min(-4.0, max(-9.0, 1.0 * (_spelling(first) + _spelling(last)))) * 2)
    bodies = min(2, sum(n in BODIES for n in names))
    return [
        "western", f"words={len(names)}", f"known={known}", f"known={known},{len(names)}", f"turned={turned}", f"like={like}", f"like={like},{known}", f"like={like},{ordinary}", f"spelled={spelled}", f"spelled={spelled},{known}", f"middle={any(w.endswith('.') for w in words[1:])}", f"initial={words[0].endswith('.')}", f"small={any(w[0].islower() for w in words)}",
        f"caps={caps}", f"caps={caps},{known}", f"comma={comma}", f"bodies={bodies}", f"ordinary={ordinary}", f"ordinary={ordinary},{known}", f"ends={last[-3:]}", f"hyphen={'-' in first + last}", f"accent={not (first + last).isascii()}",
        f"inner={any(c.isupper() for w in words for c in w[1:] if not w.isupper())}",
    ]


def _western_names(text: str) -> Iterator[Span]:
    for m in _RUN.finditer(text):
        pieces = [(p.start() + m.start(), p.group()) for p in _PIECE.finditer(m.group())]
        capital = [p[1][0].isupper() and (p[1].endswith(".") or p[1].lower() not in _NO_NAME) for p in pieces]
        for i in range(len(pieces)):
            if not capital[i]:
                continue
            full = 0
            for j in range(i, min(len(pieces), i + 6)):
                word = pieces[j][1]
                if word[0].isupper() and not capital[j]:
                    break
                full += word[0].isupper() and not word.endswith(".")
                if full > 4:
                    break
                if j == i or full < 2 - pieces[i][1].endswith(".") or not word[0].isupper() or word.endswith(".") or word.lower() in NOBODY_ENDS:
                    continue
                start, end = pieces[i][0], pieces[j][0] + len(word)
                features = _western([p[1] for p in pieces[i : j + 1]], False)
                more = f"{i > 0 and capital[i - 1]}{j + 1 < len(pieces) and capital[j + 1]}"
                yield _span(text, start, end, "name", *features, f"more={more}")
    for m in _COMMA.finditer(text):
        last, first, initial = m.groups()
        if last.lower() in _NO_NAME or first.lower() in _NO_NAME or last.lower() in NOBODY_ENDS:
            continue
        yield _span(text, m.start(), m.end(), "name", *_western([last, first, *initial.split()], True), "more=FalseFalse")
