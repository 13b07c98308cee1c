"""Thresholds, vocabularies and schemas of case data."""

from __future__ import annotations

MIN_SAMPLE, SOFT_SAMPLE, SUPPLY_MIN_SAMPLE, RISK_TOP_N, LOW_SUPPLY_MAX = 30, 100, 10, 10, 5
POOL, MIN_DECIDED, MIN_SCOPE, SCOPE_BOOST, REL_MARGIN, MIN_SIMILARITY = 30, 5, 3, 0.02, 0.06, 0.5
MAX_TOKENS, REPORT_MONTHS, PAGE_SIZE, BOARD_SIZE = 6, 24, 25, 30

# fixed values: states, their board order, and the fields that are compared between snapshots
REVIEW, RECRUIT, MEETING, CONTRACT, PROGRESS, SUCCESS, CANCELLED = "검수", "모집", "미팅중", "계약", "진행", "완료(성공)", "완료(취소)"
BOARD = (REVIEW, RECRUIT, MEETING, CONTRACT, PROGRESS, SUCCESS, CANCELLED)
ALL = "전체"
PRE_CONTRACT, POST_CONTRACT = (REVIEW, RECRUIT), (CONTRACT, PROGRESS, SUCCESS)
DIFF_FIELDS = {"status": "status", "budget": "budget", "term_days": "term_days", "contract_amount": "contract_amount", "inspection_manager": "manager", "deadline_at": "deadline"}

# fixed values: amount bands (upper bound in won, label)
CONTRACT_BANDS = ((5_000_000, "500만 이하"), (10_000_000, "500~1,000만"), (20_000_000, "1,000~2,000만"), (50_000_000, "2,000~5,000만"), (None, "5,000만 이상"))
BUDGET_BANDS = ((10_000_000, "1천만 미만"), (30_000_000, "1~3천만"), (50_000_000, "3~5천만"), (100_000_000, "5천~1억"), (None, "1억 이상"))
PROPOSAL_BANDS = ((1, "0건"), (5, "1~4건"), (10, "5~9건"), (20, "10~19건"), (None, "20건 이상"))

# fixed values: the twelve scored sections: weight, required, may be inapplicable, may be guessed
SECTIONS = {
    "purpose": (15, True, False, False),
    "core_problem": (10, False, True, False),
    "features": (20, True, False, True),
    "admin": (10, True, True, True),
    "users": (5, False, True, True),
    "platform": (10, True, False, True),
    "integrations": (5, False, True, True),
    "design": (5, False, True, True),
    "tech_stack": (5, False, False, True),
    "budget": (5, False, False, False),
    "timeline": (5, False, False, False),
    "deliverables": (5, False, False, True),
}
GATE = 60
# fixed values: which sections make up each part of a posting
POSTING_PARTS = {
    "프로젝트 개요": {"purpose": 0.7, "users": 0.3},
    "프로젝트 배경 및 목표": {"purpose": 0.5, "core_problem": 0.5},
    "과업 범위 — 수행 범위": {"platform": 0.6, "design": 0.4},
    "과업 범위 — 상세 기능": {"features": 0.8, "integrations": 0.2},
    "과업 범위 — 관리자 기능": {"admin": 1.0},
    "기술/제조 스택": {"tech_stack": 1.0},
    "주요 일정": {"timeline": 1.0},
    "지원 자격 및 우대 사항": {"deliverables": 0.5, "integrations": 0.2, "platform": 0.3},
    "산출물": {"deliverables": 1.0},
}
# fixed values: man-days and monthly price (10,000 won) by part and level
RATES = {
    ("plan", "L1"): (0.25, 300), ("plan", "L2"): (0.5, 400), ("plan", "L3"): (1.0, 500),
    ("design", "L1"): (0.5, 300), ("design", "L2"): (1.0, 400), ("design", "L3"): (2.0, 500),
    ("dev", "L1"): (0.5, 400), ("dev", "L2"): (1.5, 700), ("dev", "L3"): (3.0, 1000),
}
DAYS_PER_MONTH, QA_RATIO, QA_PRICE, PM_RATIO, PM_PRICE, BUFFER, EMBEDDED, RND_PRICE = 21, 0.15, 325, 0.15, 650, 1.1, 1.3, 1000
EMBEDDED_TYPE, RND_TYPE = "임베디드 SW", "R&D"

#: Account of a manager to a name; accounts that it lacks show as they are.
MANAGERS = {f"manager_{i}": f"Manager {i}" for i in range(5)}

# fixed values: the tags that risks, cancellations and scarce supply may carry
RISK_TAGS = ("외부 연동", "결제·정산", "데이터 정합성", "요구사항 불명확", "일정 압박", "비용 초과", "기술 실현 불확실", "성능·트래픽", "보안·개인정보", "규제·심사", "레거시·이관", "AI 정확도", "하드웨어·기기", "자료 미비", "운영·의사결정")
CANCEL_TAGS = ("클라이언트 연락두절", "요구사항·범위 변경", "타 업체 선정", "클라이언트 내부 사정", "사업 방향 불확실", "파트너 부적합", "예산·자금 부족", "일정 지연·보류", "자체 개발 전환", "법률·정책 제약", "플랫폼 조건 불일치")
SUPPLY_TAGS = ("회로·펌웨어·임베디드", "기구설계·제조도면", "산업제어(PLC/SCADA/HMI)", "레거시·폐쇄형 스택", "특정 SaaS·솔루션 종속", "상주·출장·지역 제한", "규제·인증 대응", "연구성 PoC·자문", "게임엔진·3D·VR", "인프라 이전·장애 대응", "디자인 단건·에셋", "기존 코드 인수인계", "다국어·해외 타깃")
# fixed values: roles that may stand before a follow-up, and what replaces anybody else
ROLES, PERSON = ("클라이언트", "파트너", "매니저", "고객사", "개발사"), "담당자"
# fixed values: guesses that say nothing, by containment and by equality
GUESS_EXAMPLES = ("요구사항 정의 필요", "일정 협의 필요", "품질 관리 필요", "예산 확정 필요")
GUESS_SHAPE = ("보통 … 하는 경우가 많다", "…가 따라오는 편")
# fixed values: kinds of projects (the first is the default), the four options, and the purposes of questions (the first is the default)
PROJECT_TYPES = ("일반 SW", "임베디드 SW", "R&D")
OPTIONS = (("A", "Standard (100%)"), ("B", "Value (80%)"), ("C", "Lean MVP (60%)"), ("D", "Extreme (40%)"))
PURPOSES = ("범위", "견적", "둘다")
NO_PERIOD, MIN_FREQUENCY = "미정", 2
# fixed values: labels of a case's chips
PLANNING_LABELS = {"idea": "아이디어 단계", "detail": "상세 기획 있음", "document": "기획서 보유"}
TURNKEY = "턴키"
# fixed values: white space as the rules for quotes mean it, and what else a quote is compared without
WHITE_SPACE = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
QUOTE_MARKS = r".,!?~\"'`()\[\]{}·…-"
