"""Words that rules look for, as arguments' defaults. Fixed values of the asset-management domain.

A word that holds another one of its list is left out, as the shorter one finds it too.
"""

#: Category of a document by the first list with a word in it.
CATEGORY_RULES = [
    ("물품 반납 관리", ["반납", "반환"]),
    ("물품 불용 관리", ["불용", "사용 중단"]),
    ("물품 처분 관리", ["처분", "폐기", "매각", "멸실", "도난"]),
    ("물품 취득 관리", ["취득", "등록", "검수", "G2B", "목록번호"]),
    ("물품 보유 현황", ["보유", "현황", "조회"]),
    ("사용주기 AI 예측", ["AI", "예측", "사용주기", "내용연수"]),
]
DEFAULT_CATEGORY = "일반"

#: Manual of a question by the first list with a word in it, spaces removed.
MANUAL_ROUTES = [
    ("manual_chapter1.json", ["취득", "정리일자", "자산등록"]),
    ("manual_chapter2.json", ["운용", "라벨", "물품고유번호"]),
    ("manual_chapter3.json", ["반납"]),
    ("manual_chapter4.json", ["불용"]),
    ("manual_chapter5.json", ["처분"]),
    ("manual_chapter6.json", ["보유", "현황", "조회기준", "목록"]),
    ("manual_chapter7.json", ["사용주기", "AI예측", "수명", "교체시기", "분석"]),
    ("manual_chapter8.json", ["챗봇", "도움말", "사용법", "가이드"]),
]

#: Buttons whose words stand in a question or its answer.
BUTTONS = [
    ("return", ["반납"]),
    ("disposal", ["처분", "불용"]),
    ("acquisition", ["취득", "자산등록"]),
    ("status", ["보유현황", "상태"]),
    ("forecast", ["사용주기", "AI예측", "AI 예측"]),
]

#: Label and address of each button.
BUTTON_LINKS = {
    "return": ("물품 반납 관리 바로가기", "/return-management"),
    "disposal": ("불용/처분 관리 바로가기", "/disposal-management"),
    "acquisition": ("자산 취득 등록 바로가기", "/acquisition-management"),
    "status": ("보유현황조회 바로가기", "/status-inquiry"),
    "forecast": ("사용주기 AI 예측 바로가기", "/ai-forecast"),
}

#: Text of the service level of each risk level.
SERVICE_LEVELS = {"Low": "50% 수준", "Medium": "90% 수준", "High": "95% 이상 안정"}

COMPARISON_WORDS = ["차이", "비교", "구분", "다른", "vs", "VS"]
LIST_WORDS = ["faq", "자주묻는", "질문리스트", "질문목록"]
DOC_TYPE_ORDER = {"manual_chunk": 0, "faq": 1, "domain_guide": 2, "qa": 3}
SENSITIVE_KEYS = ["password", "secret", "token", "auth", "apikey", "ssn", "card_number", "phone"]
MANUAL_FIELDS = ["summary", "process_summary", "location", "trigger_condition", "process_steps", "buttons_and_functions", "input_fields", "search_conditions",
                 "list_display_items", "terms_dictionary", "date_comparison", "warnings", "notes", "content"]
SEVERITY_HIGH = "소프트웨어|공학|전산|AI|정보|공과|컴퓨터"
SEVERITY_MIDDLE = "연구|실험|과학"
PHYSICAL_REASONS = ["고장/파손", "노후화", "노후화(성능저하)", "성능저하", "수리비용과다", "내용연수경과", "내구연한 경과(노후화)"]
USAGE_WORDS = {"infra": "라우터|하드디스크|서버|네트워크", "it": "노트북|데스크톱|모니터|프린터|스캐너", "furniture": "책상|의자|소파|탁자|보조장",
               "lab": "소프트웨어|공학|공과|전산|AI|컴퓨터|자연과학", "support": "학생지원|시설"}
#: Windows of the institution's calendar: month, first and last day.
DISUSE_WINDOWS = [(2, 1, 25), (8, 1, 25), (12, 1, 20)]
DISPOSAL_WINDOWS = [(2, 10, 28), (8, 10, 31), (12, 1, 24)]
