"""What the policy and scoring rules look for.

The rules come in two sets: ``strict`` (markers, then a regular expression with
word boundaries) and ``fast`` (plain substrings).  A marker list is a cheap
test that comes before its expression.
"""

# Word lists and patterns of the rules, in their natural order.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
# The same texts match as by EMAIL, in time linear in the text: a run of name characters is entered at its last word only.
EMAIL_ONCE = r"(?:\b[A-Za-z0-9_]++[.%+-]*+|\b[.%+-]++)@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
# Fixed values, continued.
SECRET_MARKERS = ("sk-", "api_key", "api-key", "secret", "token", "password", "akia")
SECRET = r"(?i)\b(sk-[A-Za-z0-9_-]{16,}|(api[_-]?key|secret|token|password)\s*[:=]\s*[A-Za-z0-9_./+=-]{12,}|AKIA[0-9A-Z]{16})\b"
SECRET_KEYS = ("api_key", "api-key", "secret", "token", "password")
MARKET_MARKERS = ("cryptocurrency", "crypto", "bitcoin", "ethereum", "stock", "nvda", "invest", "financial advisor", "portfolio", "market")
MARKET_TERMS = (
    "cryptocurrency", "crypto", "bitcoin", "ethereum", "stock alert", "stock price", "nvidia stock", "nvda", "investing plan", "investment decision",
    "financial advisor", "portfolio", "market timing", "market volatility", "dollar-cost averaging",
)
MARKET = r"(?i)\b(" + "|".join(MARKET_TERMS) + r")\b"
BAD_CODE_MARKERS = ("flask(", "if name", "copy code", "blenderpy")
BAD_CODE = r"(?i)\bFlask\(name\)|\bif\s+name\s*==\s*['\"]main['\"]|python\s+Copy code|\bblenderpy\b"
BAD_CODE_TERMS = ("flask(name)", "if name == 'main'", 'if name == "main"', "python copy code", "blenderpy")
MOJIBAKE = "�|Ã.|â€|鈥|檚|搒|揷|榚|茅|铆|€|缁|涓€|璇|鐢|鍚|鏁|鐓|楠|姹"
MOJIBAKE_TERMS = ("�", "Ã", "â€", "鈥", "檚", "搒", "揷", "榚", "茅", "铆", "€", "缁", "涓€", "璇", "鐢", "鍚", "鏁", "鐓", "楠", "姹")
PERSONA_MARKERS = ("pretend", "roleplay", "act", "mommy", "baby girl")
PERSONA = r"(?i)\b(pretend|roleplay|act)\b.{0,80}\b(6|six|7|seven|8|eight)\s*(year[- ]old|yo)\s+(girl|boy|child)|\b(call me mommy|hi mommy|baby girl)\b"
PERSONA_PLAY, PERSONA_WHO = ("pretend", "roleplay", "act"), ("girl", "boy", "child")
PERSONA_AGE = ("6 year old", "six year old", "7 year old", "seven year old", "8 year old", "eight year old")
PERSONA_ALONE = ("call me mommy", "baby girl")
SENSITIVE = ("passcode", "phone", "pin", "password")
FORCING = ("guess", "brute force", "generate combinations", "test each combination", "try every")
_S, _F = "|".join(SENSITIVE), "|".join(FORCING)
UNSAFE = rf"(?is)\b({_S})\b.{{0,500}}\b({_F})\b|\b({_F})\b.{{0,500}}\b({_S})\b"
URL_ONLY = r"(?i)^\s*(https?://\S+\s*){1,3}$"
CODE_MARKERS = ("```", "traceback", "pytest", "unittest", "def ", "class ", "function", "typeerror", "valueerror", "compiler", "runtime error", "stack trace", "exception")
CODE = r"(?i)```|\bTraceback\b|\bpytest\b|\bunittest\b|\bdef\s+\w+|\bclass\s+\w+|\bfunction\b|\bTypeError\b|\bValueError\b|\bcompiler\b|\bruntime error\b|\bstack trace\b|\bexception\b"
FAILURE = ("fail", "error", "traceback", "pytest", "exception")
TOOL_TERMS = ("tool", "function call", "schema", "json schema", "argument", "sandbox", "terminal", "command")
SECURITY_TERMS = (
    "cve", "cwe", "vulnerability", "sanitize", "injection", "xss", "sqli", "ssrf", "auth bypass", "access control", "exploitability", "security audit", "patch diff", "secure coding",
)
REASONING_TERMS = ("prove", "derive", "step by step", "why", "because", "therefore")
ZH_DEBUG = ("报错", "错误", "异常", "堆栈", "调试", "复现", "修复", "回归测试", "单元测试", "编译失败", "运行失败")
ZH_TOOL = ("工具调用", "工具", "命令", "终端", "接口", "函数调用", "JSON", "模式", "沙箱")
ZH_SECURITY = ("漏洞", "注入", "越权", "鉴权", "权限绕过", "安全审计", "攻击面", "补丁", "修补", "XSS", "SSRF", "SQL注入")
ZH_REASONING = ("为什么", "原因", "步骤", "推导", "证明", "因为", "所以", "怎么")
REPAIR = r"(?i)\b(actually|correction|fix(?:ed|ing)?\s+(?:bug|issue|error|test)|regression test|root cause|I was wrong)\b"
REPAIR_TERMS = (
    "actually", "correction", "fixed bug", "fixing bug", "fix bug", "fixed issue", "fixing issue", "fix issue", "fixed error", "fixing error", "fix error",
    "regression test", "root cause", "i was wrong",
)
GENERIC_REPLIES = ("sure", "yes", "ok", "i can help with that")
CUES, CUE_MARKS = ("how", "why"), ("?", "？", "怎么")
LICENSES = ("apache-2.0", "odc-by", "cc-by-4.0", "cc-by-sa-3.0", "cc-by-sa-4.0", "mit")
LANGUAGES = ("en", "eng", "english", "zh", "zh-cn", "zh-hans", "zh-hant", "zho", "cmn", "chinese", "simplified chinese", "traditional chinese", "yue")
CHINESE = ("zh", "zh-cn", "zh-hans", "zh-hant", "zho", "cmn", "chinese", "simplified chinese", "traditional chinese", "yue", "中文", "cn")
ENGLISH = ("en", "eng", "english")
USERS, ASSISTANTS = ("user", "human", "prompter"), ("assistant", "gpt", "chatbot", "bot")


def words(terms: tuple[str, ...]) -> str:
    """A case-insensitive expression for any of the terms between word boundaries."""
    return r"(?i)\b(" + "|".join(terms) + r")\b"
