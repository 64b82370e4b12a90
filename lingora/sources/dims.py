"""Dimension tables and word lists whose values are fixed by the data format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Language codes and their FLORES-200 codes, in the order that decides reverse lookups.
FLORES = {
    "zh": "zho_Hans", "zh-CN": "zho_Hans", "zh-TW": "zho_Hant", "zh-HK": "zho_Hant", "yue": "yue_Hant", "en": "eng_Latn", "ja": "jpn_Jpan",
    "ko": "kor_Hang", "fr": "fra_Latn", "de": "deu_Latn", "es": "spa_Latn", "ru": "rus_Cyrl", "ar": "arb_Arab", "pt": "por_Latn", "it": "ita_Latn",
    "th": "tha_Thai", "vi": "vie_Latn", "id": "ind_Latn", "ms": "zsm_Latn", "nl": "nld_Latn", "pl": "pol_Latn", "tr": "tur_Latn", "hi": "hin_Deva",
    "uk": "ukr_Cyrl", "sv": "swe_Latn", "da": "dan_Latn", "fi": "fin_Latn", "no": "nob_Latn", "cs": "ces_Latn", "el": "ell_Grek", "he": "heb_Hebr",
    "hu": "hun_Latn", "ro": "ron_Latn", "bg": "bul_Cyrl", "hr": "hrv_Latn", "sk": "slk_Latn", "sr": "srp_Cyrl", "ca": "cat_Latn", "et": "est_Latn",
    "lv": "lvs_Latn", "lt": "lit_Latn", "bn": "ben_Beng", "ta": "tam_Taml", "te": "tel_Telu", "ml": "mal_Mlym", "mr": "mar_Deva", "ur": "urd_Arab",
    "sw": "swh_Latn",
}

# Supported languages as code, English name, own name.
LANGUAGES = [
    ("zh", "Chinese (Simplified)", "简体中文"), ("zh-TW", "Chinese (Traditional)", "繁體中文"), ("en", "English", "English"), ("ja", "Japanese", "日本語"),
    ("ko", "Korean", "한국어"), ("fr", "French", "Français"), ("de", "German", "Deutsch"), ("es", "Spanish", "Español"), ("ru", "Russian", "Русский"),
    ("ar", "Arabic", "العربية"), ("pt", "Portuguese", "Português"), ("it", "Italian", "Italiano"), ("th", "Thai", "ไทย"), ("vi", "Vietnamese", "Tiếng Việt"),
    ("id", "Indonesian", "Bahasa Indonesia"), ("ms", "Malay", "Bahasa Melayu"), ("nl", "Dutch", "Nederlands"), ("pl", "Polish", "Polski"),
    ("tr", "Turkish", "Türkçe"), ("hi", "Hindi", "हिन्दी"), ("uk", "Ukrainian", "Українська"), ("sv", "Swedish", "Svenska"), ("da", "Danish", "Dansk"),
    ("fi", "Finnish", "Suomi"), ("no", "Norwegian", "Norsk"), ("cs", "Czech", "Čeština"), ("el", "Greek", "Ελληνικά"), ("he", "Hebrew", "עברית"),
    ("hu", "Hungarian", "Magyar"), ("ro", "Romanian", "Română"), ("bg", "Bulgarian", "Български"), ("hr", "Croatian", "Hrvatski"), ("sk", "Slovak", "Slovenčina"),
    ("sr", "Serbian", "Српски"), ("ca", "Catalan", "Català"), ("et", "Estonian", "Eesti"), ("lv", "Latvian", "Latviešu"), ("lt", "Lithuanian", "Lietuvių"),
    ("bn", "Bengali", "বাংলা"), ("ta", "Tamil", "தமிழ்"), ("te", "Telugu", "తెలుగు"), ("ml", "Malayalam", "മലയാളം"), ("mr", "Marathi", "मराठी"),
    ("ur", "Urdu", "اردو"), ("sw", "Swahili", "Kiswahili"),
]

# English names of languages.
ALIASES = {
    "chinese": "zh", "simplified chinese": "zh", "traditional chinese": "zh-TW", "english": "en", "japanese": "ja", "korean": "ko", "french": "fr",
    "german": "de", "spanish": "es", "russian": "ru", "arabic": "ar", "portuguese": "pt", "italian": "it", "thai": "th", "vietnamese": "vi",
    "indonesian": "id", "malay": "ms",
}

# Characters that count as simplified and as traditional Chinese.
SIMPLIFIED = "国东车书学门问题说话读写买卖开关进出长短高低大小多少上下左右前后里外早晚远近快慢好坏新旧长短轻重冷热明暗干湿软硬深浅宽窄厚薄粗细快慢强弱难易贵贱"
TRADITIONAL = "國東車書學門問題說話讀寫買賣開關進出長短高低大小多少上下左右前後裡外早晚遠近快慢好壞新舊長短輕重冷熱明暗乾濕軟硬深淺寬窄厚薄粗細快慢強弱難易貴賤"

# Script ranges that give a language by themselves.
RANGES = [
    ("zh", 0x3400, 0x4DBF), ("ja", 0x3040, 0x30FF), ("ko", 0xAC00, 0xD7AF), ("ru", 0x0400, 0x04FF), ("ar", 0x0600, 0x06FF), ("th", 0x0E00, 0x0E7F),
    ("hi", 0x0900, 0x097F), ("bn", 0x0980, 0x09FF), ("ta", 0x0B80, 0x0BFF), ("te", 0x0C00, 0x0C7F), ("ml", 0x0D00, 0x0D7F), ("he", 0x0590, 0x05FF),
    ("el", 0x0370, 0x03FF),
]

# Built-in translation models (id, kind, pairs, priority, language tags needed), in order.
MODELS = [
    ("Xenova/opus-mt-zh-en", "opus-mt", [("zh", "en")], 1, False),
    ("Xenova/opus-mt-en-zh", "opus-mt", [("en", "zh")], 1, False),
    ("Xenova/nllb-200-distilled-600M", "nllb", [], 100, True),
]

# Words that a key leaves out.
KEY_STOPS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "please", "the", "to", "with", "your"]

# Chinese terms and their key words, in order; then whole texts.
KEY_TERMS = {"取消": "cancel", "删除": "delete", "导出": "export", "订单": "order", "详情": "details", "登录": "login", "提交": "submit", "保存": "save", "设置": "settings", "搜索": "search", "用户名": "username"}
KEY_TEXTS = {
    "异常提醒": "errorAlert", "保存设置": "saveSettings", "导出报表": "exportReports", "订单详情": "orderDetails", "请输入用户名": "enterUsername",
    "消费记录": "consumptionRecords", "账号安全": "accountSecurity", "总条记录": "totalRecords", "最大上传张图片": "maxUploadImages",
}

# Default filter rules, in order.
RULES = [
    ("skip-context", "console"), ("skip-context", "comment"), ("skip-context", "enum"), ("skip-context", "test"),
    ("skip-pattern", r"^[\d\s]+$"), ("skip-pattern", "^[a-zA-Z]"), ("min-length", 2),
]

# Words that glossary composition drops, and translations that it puts right.
DROPPED = ["a", "an", "the", "has", "to", "of"]
MISTRANSLATIONS = {"订单": ["命令", "顺序"]}


def languages(spark: SparkSession) -> DataFrame:
    """(code, name, native_name)."""
    return spark.createDataFrame(LANGUAGES, "code string, name string, native_name string")


def flores(spark: SparkSession) -> DataFrame:
    """(ord, code, flores)."""
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(FLORES.items())], "ord int, code string, flores string")


def models(spark: SparkSession, extra: list[tuple] = ()) -> DataFrame:
    """(ord, id, type, pairs, priority, tagged); registering a model sorts all by priority, stably."""
    rows = list(MODELS)
    for m in extra:
        rows = sorted([*rows, m], key=lambda r: r[3])
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, id string, type string, pairs array<struct<from:string,to:string>>, priority int, tagged boolean")
