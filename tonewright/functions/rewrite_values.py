"""Fixed values of rule rewriting: what each pattern deletes or replaces, in the order patterns apply."""

from __future__ import annotations

# --- fixed values -------------------------------------------------------------------------------------

DELETED = {
    "p02": [
        "这就是真正的价值", "这才是最重要的", "意义重大", "这才是关键", "这才是重点", "这才是核心", "这才是本质", "这才是根本", "这才是目的", "这才是意义",
        "This is what really matters", "This is the real value", "This is the key point", "This is what it's all about", "This is the bottom line",
    ],
    "p03": [
        "值得注意的[，,]", "让我们[^。]*?[，,]", "首先[，,]", "毋庸置疑[，,]", "众所周知[，,]", "不难发现[，,]", "不难看出[，,]", "不难理解[，,]", "不难想象[，,]",
        "It is important to note that", "It should be emphasized that", "It is worth mentioning that", "Let's dive into", "Let's take a closer look",
        "First and foremost", "Needless to say", "As we all know",
    ],
    "p04": [
        "这不是关于[^。]*?[。]", "这不仅仅是[^。]*?[。]", "这并非[^。]*?[。]", "这不能简单地说[^。]*?[。]",
        r"It'?s not about[^.]*\.", r"It'?s not just[^.]*\.", r"This is not simply[^.]*\.", r"It'?s not that[^.]*\.",
    ],
    "p06": [
        "有人可能会说", "有观点认为", "有人可能会认为", "不可否认的是", "诚然", "毋庸置疑",
        "it could be argued", "it has been argued", "some might say", "some would argue", "one could argue", "admittedly", "it is often said",
    ],
    "p08": [
        "值得注意的是", "需要强调的是", "必须指出的是", "我们可以看到", "不难发现", "众所周知", "不言而喻",
        "it is worth noting", "it is important to note", "it should be noted", "it is worth emphasizing", "one can see", "it goes without saying",
        "as we can see", "it is evident that",
    ],
    "p09": [
        "专家(?:表示|认为|指出)", "据(?:调查|研究|统计)", "研究表明", "调查显示", "数据显示", "有(?:人|专家)指出", "据(?:专家|权威)透露",
        "studies show", "research shows", "experts say", "experts believe", "it is said that", "according to (?:a |the )?(?:study|research|survey)",
        "statistics show", "data shows",
    ],
    "p11": [
        "但这是否意味着", "难道我们不应该", "这难道不是", "又怎能不", "怎能不",
        "isn't it (?:true|clear|obvious) that", "doesn't it (?:make sense|follow) that", "shouldn't we", "how can we (?:not|ignore)", "what if",
    ],
    "p12": [
        "此外", "另外", "与此同时", "基于此", "因此", "于是", "鉴于此", "综上所述", "总之", "总的来说", "从某种意义上说", "从整体来看",
        "furthermore", "moreover", "in addition", "additionally", "therefore", "thus", "consequently", "as a result", "in conclusion", "to sum up",
        "overall", "in summary", "it is important to note that", "it is worth noting that", "notably", "significantly",
    ],
    "p13": [
        "is (?:considered|believed|thought|seen) (?:to be )?", "was (?:found|discovered|shown) to be", "it is (?:considered|believed|thought) that",
        "it has been (?:shown|demonstrated|proven) that",
    ],
    "p15": [
        "该技术的应用", "该技术的实现", "这一举措", "该方案的实施", "本项目", "该系统的建设", "这一过程", "上述(?:分析|研究|工作)",
        "the implementation of", "the application of", "the utilization of", "the deployment of", "the development of", "this initiative",
        "the aforementioned", "the aforementioned (?:study|research|work|analysis)",
    ],
    "p16": [
        "综上所述", "总之", "总的来说", "总括而言", "一言以蔽之", "简而言之",
        "in conclusion", "to sum up", "to summarize", "in summary", "to conclude", "overall", "all in all", "in a nutshell",
    ],
    "p19": [
        "极为", "极其", "十分", "格外", "分外", "尤为",
        r"\bvery\b", r"\bquite\b", r"\bextremely\b", r"\bhighly\b", r"\btremendously\b", r"\bexceedingly\b", r"\bexceptionally\b", r"\bremarkably\b",
        r"\babsolutely\b", r"\bcompletely\b",
    ],
    "p21": [
        "换句话说", "换言之", "也就是说", "换句话说讲", "换句话说来",
        "in other words", "that is to say", r"i\.e\.", r"viz\.", "to put it another way", "to rephrase", "in simpler terms",
    ],
    "p22": [
        "第[一二三四五]点[是为：:]", "第[一二三四五]项[是为：:]", "首先[，,].*?其次[，,].*?(?:最后|第三)",
        r"point\s+\d+[：:]", "first[ly]?[，,].*?second[ly]?[，,].*?(?:finally|third)", r"1[.)]\s+.*?2[.)]\s+.*?3[.)]\s+",
    ],
    "p24": [
        "我们必须", "我们应该", "大家应该", "理应", "务必要",
        "we must", "we should", "you must", "we have to", "it is essential that", "it is crucial that", "it is imperative that",
    ],
}
ORDINALS_ZH = ["首先", "其次", "再次", "最后", "最后一点", "第一步[，,、:：]", "第二步[，,、:：]", "第三步[，,、:：]"]
ORDINALS_EN = ["first(?:ly)?", "second(?:ly)?", "third(?:ly)?", "finally", "lastly", "in the first place", "in the second place", "to begin with", "next"]
VERBS = {"进行": "优化|改进|调整|改革|升级|部署|实施|检查", "做出": "决定|选择|判断|贡献|努力", "加以": "考虑|分析|优化|改进", "予以": "支持|考虑|处理|解决"}
NOUN_PHRASES_EN = [
    "make a (?:decision|choice|determination)", "perform (?:an? )?(?:analysis|evaluation|assessment|optimization)",
    "conduct (?:an? )?(?:investigation|study|analysis|review)", "implement (?:a |the )?(?:solution|strategy|plan|system)",
    "provide (?:a |the )?(?:solution|solution|response|answer)",
]
PLAIN_ZH = {"利用": "用", "运用": "用", "实施": "做", "开展": "做", "推进": "推进", "赋能": "赋能", "构建": "建"}
PLAIN_EN = {
    "utilize": "use", "leverage": "use", "implement": "do", "deploy": "use", "facilitate": "help", "commence": "start",
    "terminate": "end", "ascertain": "find", "methodology": "method", "utilization": "use",
}
ENGLISH_SUBJECTS = "The system|The platform|Our team|This solution|This approach|This|That"
CONNECTORS = ["另一方面", "不仅", "而且", "但", "既", "又"]
LEFTOVERS = [("。，", "，"), ("，我们要", "，"), ("，开始", "，"), ("我们开始", ""), ("然后我们开始", ""), (r"\s*,\s*we should", ""), (r"\s*,\s*we can", "")]
