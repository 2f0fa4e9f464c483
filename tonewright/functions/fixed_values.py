"""Word lists, patterns, penalties and profiles that results depend on.

All regular expressions are in the common subset of Python and Java syntax; where RE2 (the SQL check) lacks
a construct, the check has its own text in `tonewright.plans.checks`.
"""

from __future__ import annotations

# --- fixed values: word lists -------------------------------------------------------------------------

TIER1_ZH = [
    "当然", "首先", "值得注意的", "值得注意的是", "值得一提的是", "需要指出的是",
    "综上所述", "总而言之", "简而言之", "此外", "另外", "与此同时",
    "展示了", "反映了", "推动了",
    "赋能", "抓手", "闭环",
    "生态", "格局", "态势", "基石", "引擎",
    "引领",
]
TIER1_EN = [
    "Absolutely!", "Moreover", "It's worth noting", "It is important to note",
    "Delve", "tapestry", "leverage", "seamless", "robust", "comprehensive",
    "game-changer", "serves as", "at its core", "In summary", "To sum up",
    "In conclusion", "To conclude",
]
IDIOMS = ["与时俱进", "开拓创新", "砥砺前行", "不忘初心", "再接再厉"]
#: Core jargon nouns of the phrase table, in order, each once.
RESIDUAL_WORDS = [
    "赋能", "业务闭环", "生态", "夯实", "基座", "战略支撑", "价值最大化", "拉通", "颗粒度", "拉齐",
    "底层逻辑", "拥抱变化", "组合拳", "品效合一", "闭环", "方法论", "壁垒", "痛点", "降本增效",
]
STRONG_KEYWORDS = [
    "方面", "层面", "维度", "格局", "生态", "闭环", "全方位", "多维度", "多元化", "多层次",
    "赋能", "协同", "亮点", "变革", "转型", "引领", "全面", "深度", "高度", "广度", "全局",
    "全面性", "系统性", "整体性", "综合性", "智能化", "数字化", "数智化",
    "holistic", "comprehensive", "synergy", "leverage", "facilitate", "streamline", "robust",
    "scalable", "sustainable", "transformative", "paradigm",
]
WEAK_KEYWORDS = [
    "系统", "体系", "机制", "模式", "链路", "可持续", "价值", "优势", "特色",
    "创新", "升级", "优化", "提升", "改进", "增强", "驱动", "支撑", "展示", "反映", "推动",
    "高效", "稳定", "可扩展", "快速", "智能", "灵活", "精准", "整体", "核心", "关键",
    "降低", "改善", "加速", "交付", "简化", "systematic", "enhance", "optimize",
]
HARD_SLANG = [
    "智商税", "傻傻", "不香吗", "抄作业", "社恐", "瞎扯淡", "活久见",
    "绝绝子", "yyds", "栓Q", "emo", "芭比Q", "躺平", "卷王", "打工人",
    "吃瓜", "炸裂", "逆天", "魔性", "上头", "下头", "破防", "拿捏",
    "笑死", "咱就说", "家人们", "宝子们", "铁子", "老铁",
    "这玩意儿", "那玩意儿", "玩意儿",
]
LIGHT_COLLOQUIAL = [
    "说白了", "说实话", "说真的", "讲真", "怎么说呢", "你懂的",
    "手忙脚乱", "想破脑袋", "动嘴", "动动嘴", "冷冰冰", "活生生",
    "带点幽默感", "夹生", "火候", "菜谱", "买菜", "端到你面前",
    "万能钥匙", "万能金句", "百度百科", "八股文",
]
ABSTRACT_WORDS = [
    "方面", "层面", "角度", "维度", "视角", "方向", "领域", "范围", "模式",
    "形式", "方式", "方法", "策略", "路径", "方案", "机制", "体系", "系统",
    "架构", "框架", "平台", "生态", "闭环", "链路", "全链路", "全方位",
    "系统性", "全面性", "综合性", "整体性", "多维度", "多元化", "多层次",
    "可持续", "高质量发展", "协同", "赋能", "价值", "意义", "重要性",
    "优势", "劣势", "特色", "亮点", "创新", "变革", "转型", "升级",
    "优化", "提升", "改进", "增强", "扩大", "拓展", "延伸",
    "aspect", "dimension", "perspective", "framework", "architecture",
    "ecosystem", "holistic", "comprehensive", "systematic", "synergy",
    "leverage", "facilitate", "enhance", "optimize", "streamline",
    "robust", "scalable", "sustainable", "transformative", "paradigm",
]
#: Characters that end a run of Chinese characters when pseudo-words are cut.
STOP_CHARACTERS = "的了是在和与及或也都很就才还但然而因此所以我们你他她它这个那些什么怎为哪里多少几谁样啊呢吗吧嗯哦哈唉嘛呀啦哟"

# --- fixed values: patterns ---------------------------------------------------------------------------

MECHANICAL = ["首先[,，]", "其次[,，]", "最后[,，]", "First[,.]", "Second[,.]", "Third[,.]", "Finally[,.]"]
SYMMETRY = ["一方面[^。]*另一方面[^。]*", "既[^。]*又[^。]*", "不仅[^。]*而且[^。]*", "虽然[^。]*但[^。]*[^。]*"]
SYMMETRY_EN = [r"On one hand[\s\S]*?on the other hand[\s\S]*?[。.]", "not only[^.]*but also[^.]*", "both[^.]*and[^.]*"]
CROSS_SENTENCE_EN = r"not only\s+[\s\S]*?\s+(?:but also|is also)\s+[\s\S]*?[.!?]"
CLOSERS = ["综上所述", "总而言之", "简而言之", "总的来说", "由此可见", "不难看出", "具有重要意义"]
CLOSERS_EN = ["In conclusion[^.]*", "In summary[^.]*", "To conclude[^.]*", "Overall[^.]*", "In the end[^.]*", "Ultimately[^.]*"]
ABSTRACT_SUBJECTS = ["该技术的应用使得", "这一举措有助于", "在此基础上", "从某种意义上说"]
ABSTRACT_SUBJECTS_EN = ["The application of this technology[^.]*", "This initiative helps[^.]*", "On this basis[^,]*[,]", "In a sense[^,]*[,]"]
CONNECTORS_EN = ["It is important to note that[^.]*", "It should be emphasized that[^.]*", "It is worth mentioning that[^.]*"]
EM_DASHES = r"——\s*——"
MODIFIERS = ["深度的", "全方位的", "从而", "进而", "进一步", "大力", "积极", "有效", "明显", "充分"]
DENSITY = [
    "在当今快速发展的时代[，,]", "在当今时代[，,]", "随着(?:社会|科技|经济|数字)的(?:快速)?发展[，,]",
    "在(?:新|现代)形势下[，,]", "在当前(?:国际|国内)形势下[，,]", "势在必行",
]

#: Sentence patterns that cost 2 each (p23 costs nothing), in the order they are tried.
TRIAD = r"(?:^|[。！？\n])\s*([^。\n]{2,30}?[、，,])\s*([^。\n]{2,30}?[、，,])\s*([^。\n]{2,30}?)[。！\n]"
FOURFOLD = r"(?:^|[。！？\n])\s*([^。\n]{2,30}?[、，,])\s*([^。\n]{2,30}?[、，,])\s*([^。\n]{2,30}?[、，,])\s*([^。\n]{2,30}?)[。！\n]"
SENTENCES = {
    "p02_one_line_closer": "总之[^。]*?[。！]",
    "p03_staged_runup": r"我们需要[^。]*?[。！]\s*[^。]*?[。！]\s*[^。]*?[。！]",
    "p04_arguing_no_one": "应该说[^。]*?[。！]",
    "p05_forced_triads": TRIAD,
    "p07_artificial_imbalance": "[^。]*?不仅[^。]*?而且[^。]*?[。！]",
    "p08_meta_commentary": "值得注意的是[^。]*?[。！]",
    "p09_false_authority": "研究表明[^。]*?[。！]",
    "p10_list_fatigue": FOURFOLD,
    "p11_rhetorical_questions": "但这是否意味着[^。]*?[。？]",
    "p12_excessive_transitions": "[^。]*?(?:此外|另外)[^。]*?[。！]",
    "p13_passive_overuse": r"(?:is|was|been)\s+(?:considered|believed|thought|found|discovered|shown)\s+(?:to\s+be)?[^。]*?[。.]",
    "p14_nominalization": r"(?:进行|做出)(?:了|过)?[^。，,\n]{0,6}?(?:优化|改进|决定|选择|部署|实施)[^。]*?[。！]",
    "p15_abstract_subjects": "(?:该技术的应用|该技术的实现|这一举措)[^。]*?[。！]",
    "p16_formulaic_closers": "(?:综上所述|总之|简而言之)[^。]*?[。！]",
    "p17_forced_formality": r"(?:利用|运用|鉴于|遵照)\s*[^。]*?[。！]",
    "p18_repetition_rhythm": "[^。]*?(?:高效|稳定|可扩展|fast|reliable|scalable)[^。]*?、[^。]*?、[^。]*?[。！]",
    "p19_over_qualification": r"(?:极为|极其|非常| highly|extremely|quite)\s*[^。]*?[。！]",
    "p20_stilted_coordination": r"既[^。]*?[，,][\s]*又[^。]*?[。！]",
    "p21_unnecessary_clarifications": r"(?:换句话说|换言之|in\s+other\s+words|that\s+is\s+to\s+say)[^。]*?[。！]",
    "p22_over_structuring": "第[一二三四五][点项][是为：:][^。]*?[。！]",
    "p23_false_precision": r"\d+\.\d+%|数百万|数十亿|billions?\s+(?:of\s+)?(?:dollars|users|people)",
    "p24_moralizing": r"(?:我们必须|我们应该|大家应该|we\s+must|we\s+should)[^。]*?[。！]",
    "p25_vagueness_by_design": "(?:各种|诸多|若干|numerous|several|various)[^。]*?[。！]",
    "p26_mixed_code_switching": r"(?:The system|The platform|Our team|This solution|This approach|This|That)\s+[^。]*?[。！]",
}
WRAPPERS = r"[\s。！？、，,；;：:（）()\[\]【】「」\"'“”‘’]"
LONGEST_ITEM = 12

#: Judged patterns: id -> (penalty, least occurrences, regular expressions).
JUDGED = {
    "p28_body_reaction": (3, 1, [
        r"(?:我)?(?:头皮|后背|后颈|脊背|手心|心里|鼻子|眼眶|脸|血压|心跳|嗓子眼|汗毛|汗毛眼)[^。！？\n]{0,8}?"
        r"(?:麻了一下|麻了|发麻|发凉|一凉|发紧|一紧|一沉|一酸|一软|咯噔|发烫|发热|发酸|发紧|提到嗓子|揪起来|竖起来|凉了半截)",
        r"(?:我)?(?:整个人|当场|瞬间|一下就)[^。！？\n]{0,6}?(?:麻了|僵住|愣住|绷不住|破防|坐起来|跳起来)",
    ]),
    "p29_maxim_golden_line": (3, 1, [
        r"[^。！？\n，,]{2,25}的[，,]\s*比[^。！？\n]{2,25}(?:更|还|都|要)?(?:可靠|可信|重要|难得|值钱|珍贵|厉害|强|管用|有用)",
        r"越是[^。！？\n]{2,20}[，,]\s*越[^。！？\n]{2,20}",
        r"(?:真正|好的东西|真正好的)[^。！？\n]{0,12}[，,]\s*(?:从来|永远)?(?:不是|不在于|并不是)",
        r"敢(?:把|承认|说|写)[^。！？\n]{1,20}(?:出来|承认|说出口)的",
        r"说到底[，,]\s*(?:是|就是|还是|不过是)",
        r"(?:是|就是|不过是)(?:一场|一次|一门)?[^。！？\n]{0,12}(?:修行|旅程|艺术|哲学|智慧|浪漫)|这(?:件事|一路|一切)[^。！？\n，,]{0,8}(?:修行|旅程|馈赠)",
    ]),
    "p30_staged_candor": (2, 1, [
        "(?:说实话|老实说|说句实话|说实在的|说句真话|说真的|讲真|不骗你|掏心窝子|说个反常识|说个扎心的|恕我直言|不得不承认|我坦白|实不相瞒)",
    ]),
    "p31_rhetorical_identity": (3, 1, [
        r"作为(?:一个|一名|一位|个|名)?[^。！？\n]{0,20}(?:医生|兽医|护士|从业者|工程师|程序员|架构师|博主|过来人|宝妈|铲屎官|老手|内行)"
        r"[^。！？\n]{0,10}[，,][^。！？\n]{0,10}(?:我|必须|建议|想|真心)",
        r"我(?:见过|见)过(?:太多|无数|上百|上千)[^。！？\n]{0,12}",
    ]),
    "p32_template_enumeration": (2, 1, [
        r"(?:[一二三四五六七八九十两]|\d)\s*(?:件事|个点|个坑|个信号|种情况|句话|条建议|个方法|个细节|个习惯|个误区|个真相|步走|招搞定)",
        r"(?:^|[。！？\n])\s*[A-D]\s+[^。！？\n]{2,20}",
        r"第[一二三四五六七八九十\d]+(?:个|件|点|条|步)[：:，,]",
    ]),
    "p33_contrastive_negation": (3, 1, [
        r"(?:不是|并非|没有|没|不再|从不)[^。！？\n]{1,40}?[，,]\s*(?:而是|都是|全是|只是|只有)",
        r"(?:不是|并非)[^。！？\n，,]{1,30}?而是",
        r"(?:不是|并非)(?:所有|每)[^。！？\n]{1,25}?[，,]\s*也不是(?:所有|每)",
    ]),
    "p34_em_dash_abuse": (3, 2, [
        r"[\x{4e00}-\x{9fff}][—–][\x{4e00}-\x{9fff}]", "—{3,}", r"—{2}[^—\n]{1,40}—{2}", r"\s—\s",
    ]),
    "p35_medical_claim": (10, 1, [
        "(?:治疗|治愈|根治|除根|痊愈|特效|消炎|杀菌|抗菌|抗真菌|杀螨|除螨|驱螨)",
        "(?:有效|见效|疗效|显效)(?:治疗|缓解|改善|抑制|杀灭|预防|祛除|去除|止痒|止血|退烧|调理|根治|控制)",
        r"(?:猫癣|猫藓|皮肤病|感染|炎症|发炎|螨|真菌|腹泻|呕吐|咳嗽|发烧|伤口|寄生虫)[^。！？\n]{0,12}(?:有效|见效|痊愈|根治|治好)",
        "(?:药到病除|立竿见影|一用就好|三天见效|一周搞定|几天就好)",
    ]),
    "p36_absolute_claim": (4, 1, [
        "最好(?:的|用|选)",
        "第一(?![次步眼天时批版个章节行轮阶段部分篇张条页组列位层种项段级队人方，、])",
        r"(?:100\s*%|百分之百)",
        r"唯一(?=\s*(?:能够|可以|能|真正|彻底|完全|满足|解决|正确|有效|值得|选择|出路|办法|途径))",
        "(?:必备|必选|必买)",
    ]),
    "p37_replace_doctor": (10, 1, [
        r"(?:不用|无需|不必|免|省)[^。！？\n]{0,6}(?:去|跑|看)(?:医院|医生|兽医|门诊)",
        r"(?:不用|无需|不必)(?:那么)?(?:麻烦|费事)[^。！？\n]{0,8}(?:医院|医生)",
        r"比(?:医生|兽医|医院)[^。！？\n]{0,10}(?:准|强|好|专业|靠谱)",
        r"(?:医生|兽医|医院)[^。！？\n]{0,8}(?:都)?(?:没|未)(?:看|查|发现|诊断)",
    ]),
    "p38_vague_elevation": (3, 1, [
        r"在(?:当今|这个|如今)[^。！？\n]{0,20}(?:时代|社会|背景)",
        "让我们(?:一起)?(?:来)?(?:探索|走进|聊聊|看看|了解|认识)",
        "情绪价值|充满温度|充满温情",
        "值得(?:我们)?(?:深思|思考|关注|期待)",
        r"(?:不仅仅|不只是|不止是|不仅是|不光)[^。！？\n]{1,30}?[，,]\s*更是(?:一种|一场|一次|一门|对|整个|一场场)",
        r"(?:我|自己)?(?:成长了?很多|成长了不少|收获(?:了)?很多|受益匪浅|深有感触|感慨良多)(?![^。！？\n]{0,20}(?:因为|具体|比如|从[^。！？\n]{1,10}到))",
    ]),
    "p39_three_part_parallelism": (3, 1, [
        r"(?:不只是|不仅仅是|不仅是|不止是|不光)[^。！？\n]{1,25}?[，,]\s*(?:不只是|不仅仅是|不仅是|不止是|不光)[^。！？\n]{1,25}?[，,]\s*更是",
    ]),
    "p40_marketing_hype": (3, 1, [
        "神器",
        r"(?:幸福感|体验感|满足感|优越感|高级感)[^。！？\n]{0,3}拉满",
        r"直接让[^。！？\n]{1,18}?(?:拉满|翻倍|起飞|封神|上(?:了)?一个台阶)",
        r"(?:撸猫|养宠|养猫)[^。！？\n]{0,6}(?:幸福感|体验感)[^。！？\n]{0,4}(?:拉满|爆棚)",
    ]),
}
BASE_JUDGED = [
    "p28_body_reaction", "p29_maxim_golden_line", "p30_staged_candor", "p31_rhetorical_identity", "p33_contrastive_negation",
    "p34_em_dash_abuse", "p36_absolute_claim", "p38_vague_elevation", "p39_three_part_parallelism",
]

SPECIFIC = [
    r"\d{4}年\d{1,2}月\d{1,2}日", r"\d{4}[-/]\d{1,2}[-/]\d{1,2}", r"\d+\.\d+", r"\d+%", r"\d+\s*[万亿千百]",
    "[A-Z]{2,}", "[A-Z][a-z]+(?:[A-Z][a-z]+)+", r"\d+(?:GB|MB|KB|Hz|MHz|GHz|ms|s)", r"v\d+\.\d+",
]

# --- fixed values: scene profiles ---------------------------------------------------------------------

PROFILES = {
    "base": {"label": "通用底座", "aliases": ["default"], "policy": (85, 70, 55)},
    "social-note": {
        "label": "表达类内容",
        "aliases": ["social_note", "socialnote", "creative_doc", "note", "xiaohongshu"],
        "policy": (85, 68, 50),
        "penalties": {"p27_over_colloquial": 0, "p28_body_reaction": 4, "p29_maxim_golden_line": 4, "p30_staged_candor": 3, "p32_template_enumeration": 3},
        "extra": ["p32_template_enumeration", "p40_marketing_hype"],
    },
    "health-content": {
        "label": "健康内容",
        "aliases": ["health_content", "health", "medical", "pet-health", "pet_health"],
        "policy": (90, 75, 65),
        "penalties": {"p36_absolute_claim": 8, "p29_maxim_golden_line": 4, "p28_body_reaction": 4},
        "extra": ["p32_template_enumeration", "p35_medical_claim", "p37_replace_doctor", "p40_marketing_hype"],
        "compliance": ["p35_medical_claim", "p37_replace_doctor"],
        "domain": [
            "猫", "狗", "宠物", "毛孩子", "铲屎官", "喵", "汪", "兽医", "癣", "螨", "疫苗", "驱虫", "便便", "掉毛",
            "医院", "医生", "就诊", "看病", "挂号", "症状",
        ],
    },
    "tech-doc": {
        "label": "工程文档",
        "aliases": ["tech_doc", "techdoc", "code", "coder", "coder_commit", "coder_issue_reply", "coder_pr", "ops_troubleshoot", "ops_log"],
        "policy": (85, 70, 55),
        "penalties": {"p28_body_reaction": 2, "p29_maxim_golden_line": 2, "p31_rhetorical_identity": 2, "mechanical_ordering": 1},
        "exempt": {
            "tier1_zh": ["引擎", "生态", "首先", "另外", "此外", "当然", "展示了"],
            "redundant_modifiers": ["从而", "进而", "有效", "充分", "进一步", "明显"],
            "p36_absolute_claim": ["100%", "百分之百"],
            "p25_vagueness_by_design": ["各种", "若干", "诸多"],
            "p17_forced_formality": ["利用", "利用率"],
            "p19_over_qualification": ["非常"],
            "p12_excessive_transitions": ["此外", "另外", "目前"],
        },
        "off": ["symmetry_fillers"],
    },
}

# --- fixed values: scene signals ----------------------------------------------------------------------

SCENE_TARGET = {"social-note": 6.0, "health-content": 5.0, "tech-doc": 5.0}
CONFIDENT_AT, MARGIN_AT, LEAST_EVIDENCE, MOST_CONFIDENCE, PATH_PRIOR = 0.60, 0.15, 2.0, 0.97, 0.35
EMOJI = r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F000}-\x{1F2FF}\x{2B00}-\x{2BFF}]"
PARTICLES = "啊吧呢嘛哈诶哎唉呀"
ACTIONS = ["我拍", "我去", "我摸", "我带", "我找", "我家", "我翻", "我抱", "我问"]
ADVICE = (
    r"(?:建议|最好)(?:尽快|及时|立即|马上|先|去|做|带|观察|就诊|就医|检查)"
    r"|(?:应|应当|需要)(?:尽快|及时|立即|注意|就医|就诊|检查|隔离|消毒)"
    r"|需(?:尽快|及时|注意|就医|就诊|检查|隔离|消毒)"
    r"|请(?:及时|尽快|立即|带|咨询|就医|就诊)"
    r"|(?:如|一旦)(?:出现|发现|有)[^。！？\n]{0,20}(?:应|请|需|立即|尽快)"
)
SYMPTOMS = ["症状", "脱毛", "红肿", "破溃", "瘙痒", "呕吐", "腹泻", "发热", "体温", "精神差"]
MEDICAL_ACTS = ["就医", "就诊", "医院", "兽医", "医生", "诊断", "检查", "用药", "剂量", "疗程", "处方"]
DISCLAIMERS = ["不能替代", "仅供参考", "建议就医", "筛查", "初步判断"]
PETS = ["猫", "狗", "宠物", "犬", "喵", "铲屎"]
METRICS = ["P99", "QPS", "延迟", "吞吐", "错误率", "CPU", "内存", "ms"]
PATH_HINTS = {
    "social-note": ["blog", "article", "creative", "note", "xiaohongshu", "promotion", "post"],
    "health-content": ["health", "medical", "pet", "consult", "symptom"],
    "tech-doc": ["pull/", "pr/", "merge_request", "commit", "troubleshoot", "debug", "postmortem", "src/", ".py", ".ts"],
}

# --- fixed values: phrase table, in order of priority ---------------------------------------------------

PREFIX = "(?:全方位|多维度|全链路|深度|全面|持续|进一步|大力|积极|有效|充分|强力|有力地?)*"
PHRASES = [
    (PREFIX + "(?:赋能|助力)" + PREFIX + "(?:核心)?业务闭环", "支撑核心业务"),
    (PREFIX + "赋能(?:核心)?业务", "支撑业务"),
    (PREFIX + "打造" + PREFIX + "(?:数智化|数字化|智能化)" + PREFIX + "(?:新)?生态", "建设数智化平台"),
    (PREFIX + "(?:打造|构建|建设)" + PREFIX + "(?:新)?生态", "建设平台"),
    (PREFIX + "夯实" + PREFIX + "(?:底层)?(?:基座|基础)", "稳固技术基础"),
    ("为(?:核心)?(?:链路|业务)" + PREFIX + "提供" + PREFIX + "(?:战略)?支撑", "保障核心链路稳定"),
    (PREFIX + "提供" + PREFIX + "(?:强有力的|战略)?支撑", "提供可靠保障"),
    ("为(?:核心)?(?:链路|业务)?提供.{0,8}?支撑", "提供可靠保障"),
    (PREFIX + "(?:助力|推动)" + PREFIX + "(?:业务)?价值最大化落地", "让业务产生实际收益"),
    (PREFIX + "(?:助力|推动)" + PREFIX + "落地", "推动落地"),
    ("拉通对齐", "对齐目标"),
    ("对齐颗粒度", "统一下工作粒度"),
    ("拉齐颗粒度", "统一下工作粒度"),
    ("拉齐", "对齐"),
    ("颗粒度(?:太|过)?(?:粗|细|大|小)", "工作粒度"),
    ("对齐一下底层逻辑", "先理清基本思路"),
    ("底层逻辑", "基本原理"),
    ("主动拥抱变化", "适应变化"),
    ("拥抱变化", "适应变化"),
    ("通过组合拳打法", "用多种手段"),
    ("打一套?组合拳", "采取多种措施"),
    ("组合拳打法", "多种手段"),
    ("组合拳", "多种措施"),
    ("真正做到品效合一", "兼顾品牌效果和实际转化"),
    ("品效合一", "兼顾品牌效果和转化"),
    ("把.{0,10}?形成闭环", "落实到位"),
    ("形成可复用的方法论", "沉淀可复用的做法"),
    ("可复用的方法论", "可复用的做法"),
    ("沉淀方法论", "总结出可复用的做法"),
    ("反哺(?:整个)?生态", "带动后续模块"),
    ("价值闭环", "完整的价值交付"),
    ("核心壁垒", "核心竞争力"),
    ("构建壁垒", "建立竞争优势"),
    ("用户痛点", "用户的实际需求"),
    ("抓住痛点", "解决实际需求"),
    ("降本增效", "降低成本、提升效率"),
    (r"总的来说[，,]?\s*", ""),
    (r"整体来看[，,]?\s*", ""),
    (r"综上所述[，,]?\s*", ""),
    ("建议后续可以持续优化一下", "后续继续优化"),
    ("会有进一步的?提升", "会有提升"),
    ("避免出现明显的波动", "避免明显波动"),
    ("避免出现的波动", "避免波动"),
]
PROTECTED = [
    r"(?s)```.*?```",
    r"`[^`\n]+`",
    r"(?m)^[^\n]*\|[^\n]*\|[^\n]*$",
    "“[^”\\n]{1,60}”|「[^」\\n]{1,60}」|『[^』\\n]{1,60}』|\"[^\"\\n]{1,60}\"",
    r"(?:https?://|www\.)[^\s\x{4e00}-\x{9fff}\x{ff0c}\x{3002}\x{ff01}\x{ff1f}\x{ff1b}\x{ff1a}\x{3001}\x{ff08}\x{ff09}\x{3010}\x{3011}]+",
    r"[A-Za-z0-9_.+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+",
    r"[\x{4e00}-\x{9fff}A-Za-z0-9]{2,10}(?:/[\x{4e00}-\x{9fff}A-Za-z0-9]{2,10}){1,5}",
]
