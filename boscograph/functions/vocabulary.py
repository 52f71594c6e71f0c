"""Fixed values of the domain: names, types and patterns that results depend on. Each is a default that the operators take as an argument."""

from __future__ import annotations

# Standard name of a category, by its lower-case spelling; others become "其他".
CATEGORY = {
    "disease": "疾病", "pathogen": "病原", "organism": "生物", "host": "寄主", "vector": "媒介", "symptom": "症状", "treatment": "防治", "environment": "环境",
    "location": "地点", "mechanism": "机制", "process": "过程", "factor": "因素", "compound": "化合物", "misc": "其他",
}
OTHER_CATEGORY = "其他"

# Concepts too general to keep.
GENERIC = (
    "factor", "factors", "mechanism", "mechanisms", "process", "processes", "method", "methods", "approach", "approaches", "system", "systems", "compound", "compounds",
    "disease", "diseases", "organism", "organisms", "study", "studies", "research", "analysis", "result", "results",
    "因素", "机制", "过程", "方法", "系统", "化合物", "疾病", "生物", "研究", "分析", "结果", "影响", "作用", "效果", "现象", "情况",
)

# Canonical names by spelling.
CANONICAL = {
    "Bursaphelenchus xylophilus": ("松材线虫", "线虫", "bursaphelenchus xylophilus", "b. xylophilus", "pine wood nematode", "pwn"),
    "Monochamus alternatus": ("松褐天牛", "天牛", "monochamus alternatus", "m. alternatus", "japanese pine sawyer"),
    "Monochamus saltuarius": ("云杉花墨天牛", "monochamus saltuarius"),
    "Pinus massoniana": ("马尾松", "pinus massoniana", "masson pine"),
    "Pinus thunbergii": ("黑松", "pinus thunbergii", "japanese black pine"),
    "Pinus elliottii": ("湿地松", "pinus elliottii", "slash pine"),
    "Pinus densiflora": ("赤松", "pinus densiflora", "japanese red pine"),
    "Pinus yunnanensis": ("云南松", "pinus yunnanensis"),
    "Pinus armandii": ("华山松", "pinus armandii"),
    "Pine Wilt Disease": ("松材线虫病", "松树萎蔫病", "pine wilt disease", "pwd", "pine wilt"),
    "Avermectin": ("阿维菌素", "avermectin"),
    "Thiacloprid": ("噻虫啉", "thiacloprid"),
    "Imidacloprid": ("吡虫啉", "imidacloprid"),
}

# Standard entities and their aliases, in the order of preference.
ALIASES = {
    "松材线虫病": ("PWD", "Pine Wilt Disease", "pine wilt", "pine wilt disease", "松树萎蔫病", "松树枯萎病", "松枯萎病", "松树疫病"),
    "松材线虫": ("Bursaphelenchus xylophilus", "B. xylophilus", "pine wood nematode", "病原线虫", "松树线虫", "线虫病原"),
    "马尾松": ("Pinus massoniana", "P. massoniana", "masson pine"),
    "黑松": ("Pinus thunbergii", "P. thunbergii", "Japanese black pine", "日本黑松"),
    "赤松": ("Pinus densiflora", "P. densiflora", "Japanese red pine"),
    "油松": ("Pinus tabuliformis", "P. tabuliformis", "Chinese pine"),
    "松褐天牛": ("Monochamus alternatus", "M. alternatus", "松天牛", "松墨天牛"),
    "针叶变色": ("针叶褐变", "针叶黄化", "针叶枯黄"),
    "萎蔫": ("萎凋", "枯萎"),
    "清理病死树": ("疫木除治", "病死木清理", "清除病木"),
    "化学防治": ("药物防治", "化学药剂防治"),
    "浙江": ("浙江省", "Zhejiang"),
    "江苏": ("江苏省", "Jiangsu"),
    "山东": ("山东省", "Shandong"),
}

# Pronouns and what they stand for where no entity precedes them.
PRONOUNS = {"该病": "松材线虫病", "该虫": "松材线虫", "该树": "松树", "该天牛": "松褐天牛", "the disease": "Pine Wilt Disease", "the nematode": "Bursaphelenchus xylophilus", "PWD": "松材线虫病"}

# Known synonyms for merging: canonical -> others.
SYNONYMS = {
    "pine wilt disease": ("pwd", "松材线虫病", "松材线虫病害"),
    "bursaphelenchus xylophilus": ("松材线虫", "pwn"),
    "monochamus alternatus": ("松褐天牛", "墨天牛"),
    "pinus massoniana": ("马尾松",),
    "pinus thunbergii": ("黑松",),
}

# Type of a graph node by words in its name, first match wins: (type, any of, none of, case folded).
NODE_TYPE = (
    ("Disease", ("病", "disease", "wilt", "萎蔫", "枯死", "疫情"), (), False),
    ("Pathogen", ("线虫", "nematode", "xylophilus", "bursaphelenchus"), ("病",), False),
    ("Vector", ("天牛", "monochamus", "arhopalus", "beetle", "墨天牛"), (), False),
    ("Host", ("松", "pine", "pinus", "forest", "tree", "林"), ("线虫", "天牛"), False),
    ("Control", ("防治", "防控", "control", "trap", "biological", "诱捕", "药剂"), (), False),
    ("Technology", ("sentinel", "spectral", "hyperspectral", "algorithm", "遥感", "光谱", "监测"), (), True),
    ("Location", ("市", "省", "县", "区", "林场", "area", "region", "province", "mountain", "peak"), ("病",), False),
    ("Environment", ("气候", "温度", "湿度", "降雨", "土壤", "环境", "climate", "temperature", "humidity"), (), False),
)
NODE_TYPE_BY_NAME = {
    "bursaphelenchus xylophilus": "Pathogen", "pine wilt disease": "Disease", "monochamus alternatus": "Vector", "monochamus saltuarius": "Vector", "pinus thunbergii": "Host",
    "pinus massoniana": "Host", "pinus elliottii": "Host", "biological control": "Control", "trap": "Control",
}

# Type of a name in the ontology review, on the lower-case name, first match wins; "=" compares the whole trimmed name.
REVIEW_TYPE = (
    ("Pathogen", ("bursaphelenchus", "nematode", "bacteria")),
    ("Disease", ("pine wilt", "松材线虫病")),
    ("Symptom", ("=leaf",)),
    ("Host", ("pinus", "pine", "spruce", "forest", "tree")),
    ("Vector", ("monochamus", "arhopalus", "longhorn beetle", "beetle", "天牛")),
    ("ControlMeasure", ("control", "防治", "trap", "bait", "sanitation felling", "清理", "化学防治")),
    ("Symptom", ("symptom", "症状", "wilt", "wilting", "discoloration", "枯萎", "变色")),
    ("Region", ("province", "city", "county", "area", "region", "mount", "peak", "temple", "寺", "景区", "门", " valley", "峪")),
    ("EnvironmentalFactor", ("temperature", "humidity", "climate", "meteorological", "cold", "stress", "气象", "environment", "环境", "altitude", "高海拔", "低海拔")),
    ("Technology", ("spectral", "spectrum", "hyperspectral", "sentinel", "algorithm", "band", "imaging", "uav", "analysis", "detection", "scale", "光谱", "波段")),
)

# Ancestors of a type, nearest first.
HIERARCHY = {
    "Pathogen": ("Organism", "Concept"), "Disease": ("Condition", "Concept"), "Vector": ("Insect", "Animal", "Organism", "Concept"), "Host": ("Plant", "Organism", "Concept"),
    "Location": ("GeographicEntity", "Concept"), "Technology": ("Method", "Concept"), "Control": ("Treatment", "Method", "Concept"), "Environment": ("Factor", "Concept"), "Other": ("Concept",),
}

# Allowed (start, end) types of a relation; an empty list or an unknown relation allows all.
RELATION_SCHEMA = {
    "INFECTS": (("Pathogen", "Host"),),
    "PARASITIZES": (("Pathogen", "Host"), ("Pathogen", "Vector")),
    "CAUSES": (("Pathogen", "Disease"),),
    "TRANSMITS": (("Vector", "Pathogen"), ("Vector", "Disease")),
    "CARRIES": (("Vector", "Pathogen"), ("Vector", "Disease")),
    "FEEDS_ON": (("Vector", "Host"),),
    "CONTROLS": (("ControlMeasure", "Disease"), ("ControlMeasure", "Pathogen"), ("ControlMeasure", "Vector")),
    "TREATS": (("ControlMeasure", "Disease"), ("ControlMeasure", "Pathogen")),
    "PREVENTS": (("ControlMeasure", "Disease"), ("ControlMeasure", "Pathogen")),
    "SOLVES": (("ControlMeasure", "Disease"), ("ControlMeasure", "Pathogen"), ("ControlMeasure", "Vector")),
    "DISTRIBUTED_IN": (("Disease", "Region"), ("Host", "Region"), ("Vector", "Region")),
    "OCCURS_IN": (("Disease", "Region"),),
    "LOCATED_IN": (("Host", "Region"), ("Vector", "Region")),
    "MONITORS": (("Technology", "Disease"), ("Technology", "Host"), ("Technology", "Vector")),
    "APPLIES_TO": (("Technology", "Disease"), ("Technology", "Host"), ("Technology", "Pathogen")),
    "AFFECTS": (("EnvironmentalFactor", "Disease"), ("EnvironmentalFactor", "Pathogen"), ("EnvironmentalFactor", "Vector"), ("EnvironmentalFactor", "Host"), ("Pathogen", "Host"), ("Disease", "Host"), ("Disease", "Symptom")),
    "AFFECTED_BY": (("Disease", "EnvironmentalFactor"), ("Pathogen", "EnvironmentalFactor"), ("Vector", "EnvironmentalFactor")),
    "ENVIRONMENTAL_FACTOR": (("EnvironmentalFactor", "Disease"), ("EnvironmentalFactor", "Pathogen"), ("EnvironmentalFactor", "Vector"), ("EnvironmentalFactor", "Host")),
    "SYMPTOM_OF": (("Symptom", "Disease"), ("Symptom", "Pathogen")),
    "hasSymptom": (("Disease", "Symptom"),),
    "CO_OCCURS_WITH": (), "RELATED_TO": (), "COMPARES_WITH": (),
}
REVERSIBLE = ("INFECTS", "PARASITIZES", "CAUSES", "AFFECTS", "AFFECTED_BY", "CONTROLS", "TREATS", "PREVENTS", "DISTRIBUTED_IN", "LOCATED_IN", "MONITORS", "APPLIES_TO", "SYMPTOM_OF")

# The same for the relation and category names of the test tables.
TABLE_SCHEMA = {
    "feeds_on": (("vector", "host"),),
    "carried_by": (("pathogen", "vector"),),
    "treated_with": (("disease", "treatment"), ("disease", "compound"), ("pathogen", "compound")),
    "inhibits": (("compound", "pathogen"), ("treatment", "pathogen"), ("treatment", "vector")),
    "aggravates": (("environment", "disease"), ("environment", "symptom")),
    "precedes": (), "co_located": (), "derived_from": (), "co_occurs": (),
}
TABLE_REVERSIBLE = ("feeds_on", "carried_by", "treated_with", "inhibits", "aggravates")

# Weight of a type in the importance of an entity; 1 for others.
TYPE_WEIGHT = {"Disease": 10, "Pathogen": 8, "Host": 7, "Vector": 7, "Symptom": 5, "ControlMeasure": 5, "Region": 3, "EnvironmentalFactor": 4}

# Colour and label of a node type, then colour, width and label of a relation; "" holds what others get.
NODE_STYLE = {
    "Pathogen": ("#FF6B6B", "PATHOGEN"), "Disease": ("#FF8C42", "DISEASE"), "Vector": ("#4ECDC4", "VECTOR"), "Host": ("#95E1D3", "HOST"), "Location": ("#FFE66D", "LOCATION"),
    "Technology": ("#95B8D1", "TECH"), "Control": ("#A8E6CF", "CONTROL"), "Environment": ("#87CEEB", "ENVIRONMENT"), "": ("#C7CEEA", "OTHER"),
}
RELATION_STYLE = {
    "CO_OCCURS_WITH": ("#CCCCCC", 1, "共现"), "PARASITIZES": ("#FF6B6B", 3, "寄生"), "TRANSMITS": ("#FF8C42", 3, "传播"), "AFFECTS": ("#FFD93D", 2, "影响"), "CAUSES": ("#FF6B6B", 3, "引起"),
    "INFECTS": ("#FF6B6B", 3, "感染"), "FEEDS_ON": ("#4ECDC4", 2, "取食"), "CARRIES": ("#4ECDC4", 2, "携带"), "TREATS": ("#95E1D3", 2, "治疗"), "CONTROLS": ("#A8E6CF", 2, "防治"),
    "DISTRIBUTED_IN": ("#FFE66D", 2, "分布于"), "MONITORS": ("#95B8D1", 2, "监测"), "": ("#CCCCCC", 1, "相关"),
}

# Where the references of a paper begin.
REFERENCE_WORDS = ("参考文献", "引用文献", "文献引用", "参考资料", "References", "REFERENCES", "Bibliography", "Works Cited", "Cited Works", "Literature Cited", "Citations")
REFERENCE_PATTERN = r"^\s*\[\d+\]\s+|^\s*\d+\.\s+[A-Z][a-zA-Z]+\s+,|^\s*[\x{4e00}-\x{9fa5}]+\s+，\s*[\x{4e00}-\x{9fa5}]+"

# Lines of 5 to 50 characters that are page headers or footers.
HEADER_PATTERNS = (
    r"^第?\s*\d+\s*页$", r"^Page\s+\d+(/\d+)?$", r"^\d+\s*/\s*\d+$", r"^版权所有\s*@?\s*\d{4}", r"^Copyright\s*@?\s*\d{4}", r"^All Rights Reserved$",
    r"^[\x{4e00}-\x{9fa5}]+学报$", r"^[\x{4e00}-\x{9fa5}]+出版社$", r"^Journal\s+of\s+[\w\s]+$", r"^[-=*_]{3,}$",
)
HEADER_WORDS = ("第页", "页码", "版权所有", "摘要", "Abstract", "目录")
