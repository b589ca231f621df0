"""Word lists, patterns and constants that must be what they are for right results."""

# Scoring.
DECAY_EXPONENT, DECAY_SCALE, LOG_EXACT = 0.5, 0.05, 32
RS_RATE, SS_GAIN, LOG_KEEP, SIDECAR_KEEP = 0.012, 0.05, 128, 32
WEIGHTS_CONTEXT, WEIGHTS_SEARCH = (0.45, 0.35, 0.2), (0.6, 0.2, 0.2)  # overlap, retrieval strength, storage strength
SINGLE_TERM = 0.5
LEVELS = (0.3, 0.4)
PINNED, ARCHIVE_RS, STALE_TURNS, PROMOTE_AT = 0.9, 0.15, 30, 2
RECALL_FLOOR, ACTIVATION, COSINE_FLOOR = 0.08, 0.28, 0.35
BM25_K, BM25_B, NOISE_FLOOR = 1.2, 0.75, 0.1
TEMPORAL_BOOST, SELF_REFERENCE, UPDATE_BOOST = 1.3, 0.35, 1.5
PROVIDER_WEIGHT = {"local": 0.75, "xfyun": 0.45, "nvidia": 0.6}
BUDGETS = {"task": 10000, "aggregation": 60000, "temporal": 60000, "personal-fact": 30000, "assistant-content": 30000, "default": 12000}
EDGE_WEIGHTS = {"task": 0.6, "supersede": 0.8, "source": 0.5, "file": 0.5, "adjacent": 0.5}
SPREAD_DECAY, SPREAD_LEAST, SPREAD_MOST, SEEDS = 0.5, 0.15, 4, 3

# Stop words, one list for each use.
QUERY_STOPS = "the a an is are was of to in and or for on with at by".split()
LEAD_STOPS = "how what when where which who whose why is are was were be been do does did the a an of to for in on at by with from about into over after before between under out off my your his her its our their this that these those it and or but not no yes too very just also there here all any both each more most other some such only own same than because during".split()
CLUSTER_STOPS = "the a an and or but if then else when while for to of in on at by with from about into over after before between under out off are was were been being have has had having will would can could should may might must you she him her them his your its our their this that these those what which who whose where why how not yes very too just also there here all any both each more most other some such only own same than because until again once during user session said says know think really going want wanted like just".split()
TRUNCATION_STOPS = "a an the is are was were be been being have has had do does did will would could should may might shall can need must to of in on at by for with about against between into through during before after above below from up down and or but not so yet as if off over under again further once here there all any both each few more most other some such no that this these those it its i me my we our you your he him his she her they them their who which what then than when where how just also".split()

# Question classes; the first that matches counts.
CODE_ARTIFACT = r"(?i)\b[\w./-]+\.(?:go|py|ts|tsx|js|jsx|mjs|cjs|java|kt|kts|rs|c|h|cc|cpp|hpp|rb|php|swift|m|scala|dart|lua|pl|pm|sh|bash|zsh|fish|sql|json|jsonc|ya?ml|toml|ini|cfg|conf|env|lock|md|markdown|html?|css|sc?css|less|xml|proto|tf|gradle|groovy|ex(?:s)?|clj|hs|ml|nim|zig)\b"
CODE_TOKEN = r"`[^`\n]{2,}`|::|=>|\b(?:def|func|fn)\s+[A-Za-z_]\w*|\b[A-Za-z_$][a-z0-9]+(?:[A-Z][a-zA-Z0-9]+){2,}\b|\b[a-z][a-z0-9]*(?:_[a-z0-9]+){2,}\b|\b\w+\([^)\n]*\)\s*=>"
TASK_IMPERATIVE = r"(?i)^\s*(?:please\s+)?(?:fix|repair|debug|implement|add|write|create|build|refactor|update|change|modify|replace|migrate|optimi[zs]e|extend|remove|delete|handle|configure|install|patch|resolve|address|set up)\b"
TASK_HOWTO = r"(?i)^\s*(?:how|what|which|where)\b[^?]{0,40}\b(?:do|does|can|could|should|would|will)\s+(?:i|we|you)\b"
TASK_FAILURE = r"(?i)\b(?:crash\w*|stack trace|traceback|seg(?:ment)?fault|null(?:pointer| reference)|type error|compilation error|build (?:error|failure)|test(?:s)? (?:fail|fails|failing|failed)|failing test|runtime error|exception|panic|core dump|deadlock|memory leak|race condition|off-by-one)\b|\b(?:is|are|was|were|keeps|kept|still)\s+(?:broken|failing|crashing|throwing|timing out|wrong)\b"
TASK_OBJECT = r"(?i)\b(?:function|method|endpoint|handler|module|class definition|interface|component|service|worker|daemon|middleware|parser|serializer|cache|caching|pagination|rate limit\w*|rate limiter|retry|retries|backoff|debounce|throttle|validation|auth(?:entication|_token)?|token refresh|queue|consumer|producer|migration|schema|db index|test suite|unit test|integration test|docker(?:file)?|ci/cd|logger|metrics|tracing|cancel\w*|deadline|timeout|error handling|logging|stack\w*)\b"
ASSISTANT_CONTENT = r"(?i)\b(?:what|which) (?:did|do) (?:the |you |your )?(?:assistant|ai|bot|you)\b|\bwhat advice\b|\bwhat did you (?:say|suggest|recommend)\b|\bwhat (?:were|are) the (?:tips|steps|recommendations)\b|\bwhat (?:help|guidance|suggestions?)\b"
AGGREGATION = r"(?i)\bhow many\b|\bhow much\b|\bhow long\b|\btotal\b|\ball the\b|\beach of\b|\blist (?:all|the|of)\b|\b(?:average|mean|sum|combined)\b|\bthe most\b|\b(?:summari[sz]e|summary|overview|big picture|main (?:theme|point|idea|takeaway)s?|key (?:theme|point|takeaway)s?|across (?:all|my|the) (?:sessions?|conversations?|histories|whole history))\b"
TEMPORAL = r"(?i)\bwhen\b|\bhow (?:many|long).{0,30}\b(?:ago|before|after|since)\b|\bbetween\b.{0,40}\band\b|\bfirst to last\b|\b(?:first|last|earlier|earliest|latest|recent(?:ly)?)\b|\border\b|\b(?:before|after) (?:the|my|that)\b|\bsince\b|\b\d+\s*(?:days?|weeks?|months?|years?) ago\b"
PERSONAL_FACT = r"(?i)\bI\b|\bmy\b|\bme\b|\bmine\b|\bmyself\b"

# Gates.
TEMPORAL_PROMPT = r"(?i)\bhow (many|long)\b|\bago\b|\bbetween\b|\border\b|\bbefore\b|\bafter\b|\bsince\b|\bfirst\b|\blast\b|\bwhen\b|\bearliest\b|\blatest\b|\bdays?\b|\bweeks?\b|\bmonths?\b|\byears?\b|\brecent(?:ly)?\b|\bpast\b|\bwhat time\b|\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b|多久|几天|几周|几个月|什么时候|之前|之后|上次|最早|最近|顺序"
CURRENT_STATE = r"(?i)\b(?:current|currently|now|latest|most recent|as of today)\b|当前|现在|最新"
PAST_QUESTION = r"(?i)^\s*(?:when|which year|what year|in which year)\b|什么时候|哪一年|何时"
UPDATE_MARKER = r"(?i)\b(?:updat(?:e|ed|es|ing)|correction|corrections|corrected|revis(?:e|ed|es|ion)|amend(?:s|ed|ing|ment|ments)?|replac(?:e|ed|es|ing|ement)|supersed(?:e|ed|es|ing)|no\s+longer|instead|chang(?:e|ed|es|ing)\s+to)\b"
DISCLOSURE_MARKER = r"(?i)\b(by the way|btw|actually|oh,? and|also,? i|i just|i also|incidentally|come to think of it|speaking of|besides|another thing)\b"
CORRECTION_ZH = r"不要|别再|别再用|别用|错了|不对|不是.{0,12}而是|应该用|应该改成|以后(?:都|要|请)|记住|改用|换成|纠正|务必|注意要"
CORRECTION_EN = r"(?i)\b(?:don'?t|do not|must not|never|always use|instead of|stop using|correction|remember to|actually use)\b"
GENERIC_REPLY = r"(?i)as an ai|i don't have|i cannot|i'm not able"
ADVICE_NARROW = r"(?i)\b(?:recommend|suggest|any ideas|favou?rite)"
ADVICE_WIDE = r"(?i)\b(?:recommend|suggest|any ideas|favou?rite|tips|should i (?:buy|get)|help me choose)"

# Shapes in stored texts.
HEADER = r"^\[\d{4}-\d{2}-\d{2}\]\s*\(session [^)]+\)\s*\n"
SESSION_IN_HEADER = r"\(session\s+([^)\s]+)\)"
TODO_FACT = r"^task (completed|blocked): (.+)$"
OFFICE_TAGS = ["decision", "deadline", "contact", "risk", "meeting", "behavior"]

# Domains of interest, by words in lower-cased texts. (The upper-case word of one can't match; it stays as it is.)
DOMAINS = {
    "cooking": r"\b(recipe|cook|bake|ingredient|kitchen|meal|dish|restaurant|food|cuisine)\b|烹饪|食谱|做饭|美食|餐厅",
    "travel": r"\b(trip|travel|hotel|flight|visit|tour|vacation|destination|airbnb|sightseeing)\b|旅行|旅游|酒店|景点",
    "photography": r"\b(camera|photo|lens|shoot|portrait|landscape|aperture|shutter|tripod)\b|摄影|相机|拍照|镜头",
    "technology": r"\b(software|code|program|app|computer|AI|tech|algorithm|database|framework)\b|编程|软件|技术|算法",
    "health": r"\b(exercise|workout|health|diet|fitness|gym|yoga|running|medical)\b|运动|健康|健身|瑜伽",
    "music": r"\b(music|song|album|concert|band|guitar|piano|playlist|spotify)\b|音乐|歌曲|演唱会|吉他",
    "reading": r"\b(book|read|novel|author|chapter|story|fiction|literature|poetry)\b|读书|小说|作者|文学",
    "finance": r"\b(invest|stock|money|budget|salary|finance|crypto|trading|portfolio)\b|投资|股票|理财|预算",
    "gaming": r"\b(game|gaming|video game|console|playstation|xbox|nintendo|esports)\b|游戏|电竞",
    "art": r"\b(art|paint|draw|sculpture|gallery|museum|exhibition|artist|creative)\b|艺术|绘画|画展|创作",
    "science": r"\b(research|science|study|experiment|theory|physics|biology|chemistry)\b|研究|科学|实验|理论",
    "fashion": r"\b(fashion|clothes|outfit|style|brand|designer|wear|dress)\b|时尚|穿搭|服装|品牌",
    "sports": r"\b(sport|football|basketball|soccer|tennis|swimming|marathon|olympics)\b|运动|足球|篮球|体育",
    "education": r"\b(learn|course|class|study|school|university|degree|tutorial)\b|学习|课程|学校|教育",
    "nature": r"\b(nature|hiking|camping|outdoor|garden|plant|animal|wildlife)\b|自然|户外|徒步|植物",
    "film": r"\b(movie|film|cinema|documentary|series|show|watch|streaming)\b|电影|影视|纪录片|剧集",
    "language": r"\b(language|spanish|french|chinese|english|japanese|translation|fluent)\b|语言|外语|翻译|口语",
    "career": r"\b(job|career|work|office|interview|resume|promotion|project)\b|工作|职业|面试|项目",
    "family": r"\b(family|child|parent|kid|baby|mother|father|son|daughter)\b|家庭|孩子|父母|宝宝",
    "pets": r"\b(pet|dog|cat|puppy|kitten|animal|vet|breed)\b|宠物|狗|猫|动物",
}

# Rules for facts: key, pattern, groups whose texts make the value.
FACT_RULES = [
    ("degree", r"(?i)(?:i|i'm|i am|my) (?:graduated with|have|hold|earned|received) (?:a |an )?(?:degree in|major in|diploma in) (.+?)(?:\.|$)", 1),
    ("job", r"(?i)(?:i|i'm|i am|my) (?:work as|am a|am an) (.+?)(?:\.|$)", 1),
    ("location", r"(?i)(?:i|i'm|i am|my) (?:live in|moved to|am based in|am from) (.+?)(?:\.|$)", 1),
    ("name", r"(?:my name is|i'm|i am) ([A-Z][a-z]+ [A-Z][a-z]+)", 1),
    ("duration", r"(?i)(?:takes|lasts|is|are) (?:about |approximately |around )?(\d+)\s*(minutes?|hours?|days?|weeks?|months?|years?)", 2),
    ("purchase", r"(?i)(?:i|i've|i have) (?:bought|purchased|ordered|got) (?:a |an )?(.+?)(?:\.|$)", 1),
    ("visited", r"(?i)(?:i|i've|i have) (?:visited|went to|traveled to|been to) (.+?)(?:\.|$)", 1),
    ("preference", r"(?i)(?:i|i'd|i would) (?:prefer|like|love|enjoy|hate|dislike) (.+?)(?:\.|$)", 1),
    ("favorite", r"(?i)(?:my favorite|my preferred) (?:.+?) is (.+?)(?:\.|$)", 1),
    ("count", r"(?i)(?:i|i've|i have) (?:done|completed|finished|worked on) (\d+) (.+?)(?:\.|$)", 2),
    ("current", r"(?i)(?:i|i'm|i am) (?:currently|now) (.+?)(?:\.|$)", 1),
]
MONTHS = {m: i for i, names in enumerate(["january jan", "february feb", "march mar", "april apr", "may", "june jun", "july jul", "august aug", "september sep sept", "october oct", "november nov", "december dec"], 1) for m in names.split()}
