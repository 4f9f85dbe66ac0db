"""Word lists and fixed phrases, as data that callers may replace."""

from __future__ import annotations

from dataclasses import dataclass, field

# Lists, phrases and weights that must equal those users have today.
QUESTION_STOPWORDS = (
    "من", "ما", "ماذا", "متى", "اين", "أين", "هل", "هو", "هي", "عن", "في", "على", "الى", "إلى", "كم", "التي", "الذي",
    "هذه", "ذلك", "مع", "او", "أو", "اذا", "إذا", "كان", "كانت", "يكون", "الوثيقة", "المستند", "اعتمادا", "اعتمادًا", "يرجى", "رجاء",
)
ANSWER_STOPWORDS = (
    "من", "ما", "ماذا", "متى", "اين", "أين", "هل", "هو", "هي", "عن", "في", "على", "الى", "إلى", "كم", "التي", "الذي",
    "هذه", "ذلك", "كان", "كانت", "اذا", "إذا", "او", "أو", "قد", "لقد", "الوثيقة", "المستند", "اعتمادا", "اعتمادًا", "سؤال", "إجابة",
)
INTENTS = {
    "identity": ("من", "هو", "هي", "نبذة", "تعريف"),
    "temporal": ("متى", "تاريخ", "عام", "سنة", "ولد", "وفاة", "توفي"),
    "location": ("اين", "أين", "مكان", "مدينة", "بلد", "ولد"),
    "list": ("ابرز", "أبرز", "اذكر", "عدد", "ماهي", "ما هي", "المناصب", "اعمال", "أعمال"),
    "education": ("درس", "تعليم", "جامعة", "دراسة"),
    "works": ("رواية", "روايات", "ديوان", "كتاب", "اعمال", "أعمال", "ادبية", "أدبية"),
    "verification": ("هل", "صحيح", "كان", "كانت"),
}
ENTITIES = ("غازي", "القصيبي", "قصييبي", "عبد", "الرحمن")
YES_NO = "هل"
WAW = "و"
VARIANTS = {
    "temporal": "تاريخ سنة عام",
    "location": "مكان مدينة الاحساء",
    "list": "مناصب اعمال نقاط",
    "education": "تعليم جامعة الحقوق",
    "works": "روايات شعر ديوان اعمال",
}
LOCATION_WORDS = ("في", "ب", "مدينة", "منطقة", "المملكة", "الأحساء", "الاحساء")
IDENTITY_WORDS = ("هو", "احد", "أحد", "ولد", "وُلد")
EDUCATION_PARTS = ("جامعة", "تعليم", "دراسة", "الحقوق")
WORKS_PARTS = ("روا", "ديوان", "كتب", "قصائد", "الشعر")
SECTION_PARTS = ("نش", "تعليم", "حياه", "حياة")
SOURCES_HEADING = "المصادر"
DEFAULT_SECTION = "النص"
REFUSAL = "لا توجد معلومات كافية في المستند للإجابة عن هذا السؤال."
SOURCE_PREFIX = "المصادر: "
PARTIAL_MARK = "لكن لا توفر الوثيقة"
PARTIAL_TEXT = "لكن لا توفر الوثيقة معلومات واضحة عن: "
ALIASES = {
    "ميلاد": ("ولد",), "مولد": ("ولد",), "ولاده": ("ولد",), "مواليد": ("ولد",), "لميلاده": ("ولد",), "مولده": ("ولد", "الاحساء"),
    "وفاه": ("تو2010", "الخاتمه"), "وفات": ("تو2010",),
    "وزير": ("وز", "مناصب"), "وزراء": ("وز", "مناصب"), "وزاره": ("وز", "مناصب"), "وزاري": ("وز", "مناصب"),
    "roles": ("مناصب", "حكوم", "وز"), "government": ("مناصب", "حكوم"),
    "اديب": ("الادب", "اعماله"), "اديبه": ("الادب", "اعماله"), "ادبي": ("الادب",), "ادبيه": ("الادب", "اعماله"),
    "تعليم": ("التعل", "جامعه", "الحقوق"), "دراسه": ("التعل", "جامعه", "الحقوق"), "تعلم": ("التعل", "جامعه"),
    "نشاه": ("بيئه", "عائله", "كنف"), "نشات": ("بيئه", "عائله", "كنف"), "نشاته": ("بيئه", "عائله", "كنف"),
    "روايات": ("روا", "الروا"), "قصص": ("روا", "الروا"), "مؤلفات": ("الادب", "اعماله", "روا"),
    "ghazi": ("غازي",), "gosaibi": ("القصييبي", "القصيبي"), "gosabi": ("القصييبي", "القصيبي"), "algosaibi": ("القصييبي", "غازي"),
}
SYSTEM_PROMPT = (
    "أنت مولد إجابات لنظام RAG بالعربية.\nاستخدم المصادر فقط بدون أي حقائق خارجية.\nأعد النتيجة JSON فقط بالشكل:\n"
    '{"supported": true|false, "answer": "...", "sources": ["S1"], "evidence": [{"source": "S1", "quote": "..."}]}.\n'
    'اذا لم توجد اجابة مدعومة أعد: {"supported": false, "answer": "' + REFUSAL + '", "sources": [], "evidence": []}.'
)
USER_PROMPT = ("المصادر:\n----------------\n", "\n----------------\n\nالسؤال:\n", "\n")
FUSION = {"dense_rrf": 0.5, "sparse_rrf": 0.5, "lexical": 0.2, "entity": 0.15, "intent": 0.15, "reference_penalty": 0.35}
RRF_K, K1, B = 60, 1.2, 0.75


@dataclass(frozen=True)
class Lexicon:
    """What query analysis looks words up in."""

    stopwords: tuple[str, ...] = QUESTION_STOPWORDS
    intents: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(INTENTS))
    entities: tuple[str, ...] = ENTITIES
    variants: dict[str, str] = field(default_factory=lambda: dict(VARIANTS))
    yes_no: str = YES_NO
    waw: str = WAW


ARABIC = Lexicon()
