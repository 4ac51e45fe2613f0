"""Sentences about functions that are made of their names, calls and bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracelake.functions.text import _col

#: What a name's parts say that a function does, tried in order.
ACTIONS = [
    ("init|startup|boot|setup", "초기화 절차를 수행하고 기본 파라미터를 설정한다"), ("diag|check|monitor|detect|verify", "상태를 점검하고 진단 결과를 갱신한다"), ("update|refresh|calc|conv|compute|process", "입력 데이터를 처리하여 연산 결과를 갱신한다"),
    ("ctrl|control|manage|regulate", "제어 조건을 평가하고 출력 상태를 결정한다"), ("error|fault|protect|safe", "오류 조건을 감시하고 안전 보호 동작을 실행한다"), ("read|get|load|fetch", "요청된 데이터를 읽어 반환한다"), ("write|set|store|save", "지정된 값을 대상 레지스터 또는 메모리에 기록한다"),
    ("send|transmit|tx", "통신 프로토콜에 따라 데이터를 송신한다"), ("recv|receive|rx", "통신 채널로부터 데이터를 수신하여 버퍼에 저장한다"), ("isr|interrupt|handler", "인터럽트 발생 시 해당 이벤트를 처리한다"), ("timer|schedule|period|cyclic", "주기적 타이머 이벤트를 처리한다"),
    ("enable|activate|start|on", "대상 모듈 또는 출력을 활성화한다"), ("disable|deactivate|stop|off|shutdown", "대상 모듈 또는 출력을 비활성화한다"), ("reset|clear|clr", "내부 상태 및 플래그를 초기 상태로 리셋한다"), ("limit|clamp|saturate|bound", "입력값을 허용 범위 내로 제한한다"),
    ("filter|smooth|average|lpf", "입력 신호에 필터링을 적용하여 노이즈를 제거한다"), ("convert|map|scale|transform", "입력값을 목적 단위 또는 형식으로 변환한다"), ("sort|search|find|lookup", "데이터 검색 또는 정렬을 수행한다"), ("log|record|trace", "동작 이력을 기록한다"), ("test|validate|assert", "지정된 조건을 검증하고 결과를 판정한다"),
]
#: The name and the action of a function that says nothing.
NO_NAME, NO_ACTION = "해당 소프트웨어 유닛", "소프트웨어 유닛의 지정된 동작을 수행한다"
#: Conditions at the start of a body that hold before it runs, tried in order, and names of functions that need none.
PRECONDITIONS = [
    r"(?i)if\s*\(\s*!?\s*\w*(?:Init|initialized|ready|enabled|done)\w*\s*\)", r"assert\s*\(\s*(?:.{5,60}?)\s*\)", r"(?i)if\s*\(\s*\w+\s*==\s*NULL\s*\)", r"(?i)if\s*\(\s*NULL\s*==\s*\w+\s*\)", r"if\s*\(\s*\w+\s*[!=]=\s*(?:TRUE|FALSE|0[xX][0-9a-fA-F]+|0)\s*\)",
]
FIRST_CALLS, FIRST_CALLS_NOTE = r"(?i)(?:_Init|Init|Initialize|Setup)\b", "N/A (initialization function)"


def described(name: Column | str, calls: Column) -> Column:
    """A sentence from a function's name and the first five of its calls."""
    name = F.trim(F.coalesce(_col(name), F.lit("")))
    name = F.when(name == "", F.lit(NO_NAME)).otherwise(name)
    action = F
    for words, sentence in ACTIONS:
        action = action.when(F.lower(name).rlike(words), F.lit(sentence))
    parts = F.filter(F.split(F.regexp_replace(name, "(?=[A-Z])", "_"), "_"), lambda p: (p != "") & ~F.lower(p).isin("s", "g", "fn", "func"))
    context = F.array_join(F.slice(parts, 1, 3), " ")
    told = F.filter(F.transform(F.coalesce(calls, F.array().cast("array<string>")), lambda c: F.trim(c)), lambda c: c != "")
    base = F.concat(name, F.lit(": "), context, F.lit(" 모듈에서 "), action.otherwise(F.lit(NO_ACTION)), F.lit("."))
    return F.when(F.size(told) > 0, F.concat(base, F.lit(" 주요 호출 대상: "), F.array_join(F.slice(told, 1, 5), ", "), F.lit("."))).otherwise(base)


def precondition(body: Column | str, name: Column | str) -> Column:
    """Up to three conditions that the first 600 characters of a body begin with; a note for functions that set up; else the empty text."""
    start = F.substring(F.coalesce(_col(body), F.lit("")), 1, 600)
    hits = F.filter(F.array(*[F.trim(F.regexp_extract(start, p, 0)) for p in PRECONDITIONS]), lambda h: h != "")
    setting_up = F.coalesce(_col(name), F.lit("")).rlike(FIRST_CALLS) & (start != "")
    return F.when(F.size(hits) > 0, F.array_join(F.slice(hits, 1, 3), "; ")).when(setting_up, F.lit(FIRST_CALLS_NOTE)).otherwise(F.lit(""))
