"""Words of the maritime domain and what they mean in a graph; other domains pass tables of their own."""

from __future__ import annotations

# What words, units and comparators of questions stand for.
LABELS = {
    "선박": "Vessel", "배": "Vessel", "화물선": "CargoShip", "컨테이너선": "CargoShip", "탱커": "Tanker", "유조선": "Tanker", "LNG선": "Tanker", "어선": "FishingVessel",
    "여객선": "PassengerShip", "페리": "PassengerShip", "크루즈": "PassengerShip", "군함": "NavalVessel", "자율운항선박": "AutonomousVessel", "자율운항선": "AutonomousVessel", "무인선": "AutonomousVessel",
    "항구": "Port", "항만": "Port", "무역항": "TradePort", "연안항": "CoastalPort", "어항": "FishingPort", "부두": "Berth", "선석": "Berth", "정박지": "Anchorage", "터미널": "Terminal",
    "해협": "Waterway", "수로": "Channel", "통항분리대": "TSS",
    "화물": "Cargo", "위험물": "DangerousGoods", "벌크화물": "BulkCargo", "산적화물": "BulkCargo", "컨테이너": "ContainerCargo",
    "해역": "SeaArea", "바다": "SeaArea", "배타적경제수역": "EEZ", "EEZ": "EEZ", "영해": "TerritorialSea", "연안": "CoastalRegion",
    "항해": "Voyage", "항차": "Voyage", "입항": "PortCall", "사고": "Incident", "충돌": "Collision", "좌초": "Grounding", "오염": "Pollution", "조난": "Distress", "불법조업": "IllegalFishing",
    "기상": "WeatherCondition", "날씨": "WeatherCondition", "센서": "Sensor", "AIS": "AISTransceiver", "레이더": "Radar", "CCTV": "CCTVCamera", "기상관측소": "WeatherStation",
    "기관": "Organization", "정부기관": "GovernmentAgency", "해운사": "ShippingCompany", "연구소": "ResearchInstitute", "선급": "ClassificationSociety",
    "규정": "Regulation", "협약": "Regulation", "문서": "Document", "보고서": "Document", "논문": "Document", "사고보고서": "AccidentReport", "검사보고서": "InspectionReport", "항행경보": "NavigationalWarning",
    "실험": "Experiment", "시험": "Experiment", "시험시설": "TestFacility", "예인수조": "TowingTank", "빙해수조": "IceTank", "데이터셋": "ExperimentalDataset", "측정": "Measurement", "모형선": "ModelShip",
    "사용자": "User", "역할": "Role", "권한": "Permission", "데이터등급": "DataClass",
}
LINKS = {
    "위치한": "LOCATED_AT", "정박한": "DOCKED_AT", "묘박한": "ANCHORED_AT", "항해중인": "ON_VOYAGE", "출발한": "FROM_PORT", "도착할": "TO_PORT", "운반하는": "CARRIES", "수행하는": "PERFORMS",
    "관측된": "PRODUCES", "영향받는": "AFFECTS", "원인된": "CAUSED_BY", "관련된": "INVOLVES", "위반한": "VIOLATED", "검사한": "INSPECTED_BY", "발행한": "ISSUED_BY", "소유한": "OWNED_BY", "소속된": "BELONGS_TO",
    "실시한": "CONDUCTED_AT", "생성한": "PRODUCED", "포함하는": "CONTAINS", "접근가능한": "CAN_ACCESS", "역할가진": "HAS_ROLE",
}
VALUES = {
    "vesselType": {"컨테이너선": "ContainerShip", "벌크선": "BulkCarrier", "탱커": "Tanker", "유조선": "Tanker", "LNG선": "LNGCarrier", "여객선": "PassengerShip", "어선": "FishingVessel"},
    "currentStatus": {"항해중": "UNDERWAY", "정박중": "AT_BERTH", "묘박중": "AT_ANCHOR", "조업중": "FISHING", "정지": "STOPPED"},
    "incidentType": {"충돌": "Collision", "좌초": "Grounding", "오염": "Pollution", "조난": "Distress", "화재": "Fire"},
    "severity": {"경미": "LOW", "보통": "MODERATE", "심각": "HIGH", "치명": "CRITICAL"},
    "riskLevel": {"낮음": "LOW", "보통": "MODERATE", "높음": "HIGH", "매우높음": "VERY_HIGH"},
}
PORTS = {"부산항": "KRPUS", "인천항": "KRICN", "울산항": "KRULS", "여수광양항": "KRYOS", "평택당진항": "KRPTK"}
SEA_AREAS = ("남해", "동해", "서해", "대한해협")
UNITS = {"톤": ("tonnage", 1.0), "t": ("tonnage", 1.0), "미터": ("length", 1.0), "m": ("length", 1.0), "노트": ("speed", 1.0), "kt": ("speed", 1.0), "km": ("distance", 1000.0)}


def label_of(word: str, labels: dict[str, str] = LABELS) -> str | None:
    """The label of a word, else of the longest entry that it holds or that holds it."""
    if word in labels:
        return labels[word]
    near = [k for k in labels if word and (k in word or word in k)]
    return labels[max(near, key=len)] if near else None


def value_of(prop: str, word: str) -> str | None:
    return VALUES.get(prop, {}).get(word)


def entity_of(name: str) -> tuple[str, str, str] | None:
    """(label, property, value) that a well-known name stands for."""
    if name in PORTS:
        return "Port", "unlocode", PORTS[name]
    return ("SeaArea", "name", name) if name in SEA_AREAS else None
