"""Rule tables: profiles, reliability, thresholds, bands, posts and vocabularies, with their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Fixed values of the rule tables.
DOC_TYPES = ["passport", "visa", "aadhaar", "pan", "voter_id", "dl"]
TRUST_CLASSES = ["cryptographic", "arithmetic", "probabilistic", "unverified"]
VERDICTS = ["pass", "fail", "inconclusive", "not_applicable"]
SOURCES = ["ocr", "mrz", "qr", "vlm"]

WEIGHTS: dict[str, dict[str, float]] = {
    "passport": {
        "validation.signature.valid": 0.25, "validation.mrz.checkdigit.*": 0.25, "validation.vizmrz.*": 0.25,
        "face.match.cosine": 0.15, "face.*": 0.10, "tamper.*": 0.10, "validation.*": 0.10, "extraction.*": 0.05,
    },
    "visa": {
        "validation.signature.valid": 0.25, "validation.mrz.checkdigit.*": 0.20, "validation.vizmrz.*": 0.20,
        "tamper.stamp.*": 0.15, "face.match.cosine": 0.10, "face.*": 0.10, "tamper.*": 0.05, "validation.*": 0.10,
        "extraction.*": 0.05,
    },
    "aadhaar": {
        "validation.signature.valid": 0.30, "validation.verhoeff.aadhaar": 0.25, "face.match.cosine": 0.15,
        "face.*": 0.10, "tamper.*": 0.15, "validation.*": 0.10, "extraction.*": 0.05,
    },
    "pan": {
        "validation.crossdoc.*": 0.35, "validation.format.pan.id_number": 0.20, "face.match.cosine": 0.15,
        "face.*": 0.10, "tamper.*": 0.15, "validation.*": 0.10, "extraction.*": 0.05,
    },
    "voter_id": {
        "validation.crossdoc.*": 0.30, "validation.format.voter_id.id_number": 0.20, "face.match.cosine": 0.15,
        "face.*": 0.10, "tamper.*": 0.15, "validation.*": 0.15, "extraction.*": 0.05,
    },
    "dl": {
        "validation.crossdoc.*": 0.30, "validation.format.dl.id_number": 0.20, "validation.expiry.expired": 0.15,
        "face.match.cosine": 0.15, "face.*": 0.10, "tamper.*": 0.10, "validation.*": 0.05, "extraction.*": 0.05,
    },
}

_HARD_ALL = ["validation.watchlist.hit", "validation.signature.valid", "validation.crossdoc.dob_mismatch", "validation.signed.*"]
HARD_FAIL: dict[str, list[str]] = {
    "passport": [*_HARD_ALL, "validation.mrz.checkdigit.composite", "validation.expiry.expired", "validation.vizmrz.dob_mismatch"],
    "visa": [*_HARD_ALL, "validation.mrz.checkdigit.composite", "validation.expiry.expired"],
    "aadhaar": [*_HARD_ALL, "validation.verhoeff.aadhaar"],
    "pan": [*_HARD_ALL, "validation.crossdoc.name_mismatch"],
    "voter_id": _HARD_ALL,
    "dl": [*_HARD_ALL, "validation.expiry.expired"],
}

RELIABILITY: dict[str, float] = {
    "extraction.quality.blur": 0.80, "extraction.quality.resolution": 1.00, "extraction.quality.brightness": 0.70,
    "extraction.doctype.confidence": 0.70, "extraction.vlm.ratified": 0.60, "extraction.vlm.unratified": 0.20,
    "validation.signature.valid": 1.00, "validation.signature.issuer_trusted": 1.00,
    "validation.mrz.checkdigit.composite": 1.00, "validation.mrz.checkdigit.document_number": 1.00,
    "validation.mrz.checkdigit.dob": 1.00, "validation.mrz.checkdigit.expiry": 1.00,
    "validation.mrz.checkdigit.optional": 1.00, "validation.verhoeff.aadhaar": 1.00,
    "validation.crossfield.date_order": 1.00, "validation.crossfield.validity_period": 0.80,
    "validation.expiry.expired": 1.00, "validation.watchlist.hit": 0.85,
    "validation.vizmrz.dob_mismatch": 0.90, "validation.vizmrz.name_mismatch": 0.90,
    "validation.vizmrz.gender_mismatch": 0.90, "validation.vizmrz.expiry_date_mismatch": 0.90,
    "validation.vizmrz.id_number_mismatch": 0.90, "validation.vizmrz.nationality_mismatch": 0.85,
    "validation.crossdoc.dob_mismatch": 0.90, "validation.signed.name_mismatch": 0.95,
    "validation.signed.dob_mismatch": 0.95, "validation.signed.gender_mismatch": 0.95,
    "validation.crossdoc.name_mismatch": 0.90, "validation.history.impossible_transit": 0.40,
    "tamper.physical.ocrb_conformance": 0.65, "tamper.physical.guilloche_break": 0.45,
    "tamper.physical.ghost_missing": 0.55, "tamper.physical.layout_geometry": 0.60, "tamper.physical.halftone": 0.50,
    "tamper.stamp.duplicate": 0.75, "tamper.stamp.date_logic": 0.80, "tamper.stamp.count_mismatch": 0.50,
    "tamper.digital.copy_move": 0.70, "tamper.digital.exif_software": 0.75, "tamper.digital.double_jpeg": 0.50,
    "tamper.digital.noise_residual": 0.50, "tamper.digital.ela": 0.30,
    "face.doc.detected": 0.90, "face.doc.quality": 0.70, "face.live.detected": 0.90, "face.live.quality": 0.70,
    "face.live.quality.blur": 0.70, "face.live.quality.resolution": 1.00, "face.live.quality.brightness": 0.70,
    "face.liveness.passive": 0.65, "face.liveness.active": 0.80, "face.match.cosine": 0.75, "face.gallery.duplicate": 0.60,
}
RELIABILITY_DEFAULT = 0.50

ESCALATE_ON_FAIL = ["validation.vizmrz.*", "tamper.stamp.duplicate"]
CONFIRMING = ["validation.signed", "validation.crossdoc"]
LOW_COVERAGE = "Insufficient evidence - re-capture required"
TAMPER_CLEAR_BELOW = 0.15

POSTS: dict[str, tuple[str, float, float]] = {
    "raxaul": ("Raxaul integrated check post", 26.98, 84.85),
    "sunauli": ("Sunauli integrated check post", 27.45, 83.45),
    "jogbani": ("Jogbani integrated check post", 26.40, 87.27),
    "panitanki": ("Panitanki integrated check post", 26.70, 88.16),
}
MAX_GROUND_SPEED_KMH = 60

CROSS_DOCUMENT = {
    "passport": ["name", "dob", "gender"], "aadhaar": ["name", "dob", "gender"], "visa": ["name", "dob"],
    "pan": ["name", "dob", "father_name"], "dl": ["name", "dob", "father_name"], "voter_id": ["name", "dob", "gender", "father_name"],
}
VALIDITY_YEARS = {"passport": [10, 5], "dl": [20, 10, 5], "visa": [10, 5, 1]}
DOC_LABEL = {"passport": "passport", "visa": "visa", "aadhaar": "Aadhaar card", "pan": "PAN card", "voter_id": "Voter ID", "dl": "driving licence"}
FIELD_LABEL = {
    "dob": "date of birth", "id_number": "identity number", "secondary_id": "secondary identity number", "father_name": "father's name",
    "issue_date": "issue date", "expiry_date": "expiry date", "issuing_authority": "issuing authority", "mrz": "machine-readable zone",
    "person_photo": "photograph", "ghost_photo": "ghost portrait", "doc_title": "document title", "blood_group": "blood group", "qr_code": "QR code",
}


@dataclass(frozen=True)
class Bands:
    """Operating point. Scores below green are GREEN, below amber AMBER, else RED; coverage below floor is AMBER."""

    green: float = 0.20
    amber: float = 0.60
    floor: float = 0.70

    def __post_init__(self):
        if not (0 <= self.green <= self.amber <= 1 and 0 <= self.floor <= 1):
            raise ValueError("bands must satisfy 0 <= green <= amber <= 1 and 0 <= floor <= 1")


@dataclass(frozen=True)
class RuleSet:
    """The rules in force: weights by document type, hard-fail patterns, reliabilities and bands."""

    weights: dict[str, dict[str, float]] = field(default_factory=lambda: WEIGHTS)
    hard_fail: dict[str, list[str]] = field(default_factory=lambda: HARD_FAIL)
    reliability: dict[str, float] = field(default_factory=lambda: RELIABILITY)
    bands: Bands = Bands()

    def override(self, weights: dict[str, float] | None = None, bands: Bands | None = None) -> RuleSet:
        """The rules with some weights changed or added for every document type, or other bands."""
        changed = {doc: {**own, **(weights or {})} for doc, own in self.weights.items()}
        out = RuleSet(changed, self.hard_fail, self.reliability, bands or self.bands)
        out.check()
        return out

    def check(self) -> None:
        """Raise unless weights lie in 0..1 and only known document types occur."""
        for doc, own in self.weights.items():
            if doc not in DOC_TYPES:
                raise ValueError(f"unknown document type {doc}")
            if bad := [p for p, w in own.items() if not 0 <= w <= 1]:
                raise ValueError(f"{doc}: weights outside 0..1: {bad}")
        for doc in self.hard_fail:
            if doc not in DOC_TYPES:
                raise ValueError(f"unknown document type {doc}")


DEFAULT = RuleSet()


def matches(pattern: str, signal_id: str) -> bool:
    """``*`` matches all, ``x.*`` what begins with ``x.``, anything else itself."""
    return pattern == "*" or (signal_id.startswith(pattern[:-1]) if pattern.endswith(".*") else signal_id == pattern)


def weight_table(spark: SparkSession, rules: RuleSet = DEFAULT) -> DataFrame:
    rows = [(doc, p, float(w)) for doc, own in rules.weights.items() for p, w in own.items()]
    return spark.createDataFrame(rows, "doc_type string, pattern string, weight double")


def hard_fail_table(spark: SparkSession, rules: RuleSet = DEFAULT) -> DataFrame:
    return spark.createDataFrame([(doc, p) for doc, own in rules.hard_fail.items() for p in own], "doc_type string, pattern string")


def reliability_table(spark: SparkSession, rules: RuleSet = DEFAULT) -> DataFrame:
    return spark.createDataFrame(list(rules.reliability.items()), "pattern string, reliability double")


def post_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in POSTS.items()], "post_id string, post_name string, lat double, lon double")
