"""Vocabulary of entities and relations, as data: groups of spellings by what they stand for."""

from __future__ import annotations

#: Canonical relation type: the spellings read as it. Anything else is DEFAULT_RELATION.
RELATION_GROUPS: dict[str, tuple[str, ...]] = {
    "treats": ("treated_by", "treatment", "procedure", "stimulator", "treats"),
    "indicated_for": ("supports", "used_in", "useful_in", "recommended_for", "indicated_for"),
    "diagnoses": ("cut_at", "assesses", "diagnoses"),
    "causes": ("finding_causing", "causes"),
    "part_of": ("subtype_of", "type_of", "part_of"),
    "symptom_of": ("symptom", "symptom_of"),
    "complication_of": ("complication_of",),
    "contraindicated_for": ("is harmful", "contraindicated_for"),
    "associated_with": ("more strongly associated with", "related_to", "associated with", "associated_with"),
}
DEFAULT_RELATION = "associated_with"

#: Relation type: what a query says when it asks for it (substrings, lower case).
INTENT_GROUPS: dict[str, tuple[str, ...]] = {
    "treats": ("manage", "treat", "處置", "處理", "治療"),
    "causes": ("etiology", "cause", "導致", "造成", "原因"),
    "diagnoses": ("assess", "diagnos", "評估", "檢查", "診斷"),
    "complication_of": ("complication", "合併症", "併發症"),
    "symptom_of": ("presentation", "symptom", "表現", "症狀"),
    "contraindicated_for": ("contraindic", "禁忌"),
    "indicated_for": ("indication", "適應症"),
}
RELATION_BOOST = 1.15

_SHORT = """
rehab orthoses: afo=ankle foot orthosis; hkafo=hip knee ankle foot orthosis; kafo=knee ankle foot orthosis; tlso=thoracolumbosacral orthosis
joints: acl=anterior cruciate ligament; avn=avascular necrosis; pcl=posterior cruciate ligament; rct=rotator cuff tear; si=sacroiliac; thr=total hip replacement; tkr=total knee replacement
spine: ddd=degenerative disc disease; hcd=herniated cervical disc; hld=herniated lumbar disc; lbp=low back pain; nrb=nerve root block; sci=spinal cord injury
brain: cva=cerebrovascular accident; cp=cerebral palsy; ms=multiple sclerosis; tbi=traumatic brain injury
nerve: als=amyotrophic lateral sclerosis; cidp=chronic inflammatory demyelinating polyneuropathy; crps=complex regional pain syndrome; cts=carpal tunnel syndrome; gbs=guillain-barre syndrome; mps=myofascial pain syndrome
vessels and joints: abi=ankle brachial index; dvt=deep vein thrombosis; oa=osteoarthritis; pe=pulmonary embolism; ra=rheumatoid arthritis
scales: asia=american spinal injury association; fim=functional independence measure; isncsci=international standards for neurological classification of sci; mmse=mini mental state examination; mmt=manual muscle testing; moca=montreal cognitive assessment; nihss=national institutes of health stroke scale; rom=range of motion
signals: cmap=compound muscle action potential; dtr=deep tendon reflex; emg=electromyography; muap=motor unit action potential; ncs=nerve conduction study; snap=sensory nerve action potential
images: ct=computed tomography; mri=magnetic resonance imaging; us=ultrasound
stimulation: eswt=extracorporeal shock wave therapy; fes=functional electrical stimulation; nmes=neuromuscular electrical stimulation; rtms=repetitive transcranial magnetic stimulation; tdcs=transcranial direct current stimulation; tens=transcutaneous electrical nerve stimulation; vns=vagus nerve stimulation
drugs: bont=botulinum toxin; botox=botulinum toxin; ha=hyaluronic acid; nsaid=nonsteroidal anti-inflammatory drug; nsaids=nonsteroidal anti-inflammatory drug; prp=platelet rich plasma; snri=serotonin norepinephrine reuptake inhibitor; ssri=selective serotonin reuptake inhibitor; tca=tricyclic antidepressant
gait: bos=base of support; cog=center of gravity; grf=ground reaction force
"""
#: Abbreviation to its long form.
ABBREVIATIONS: dict[str, str] = dict(
    pair.strip().split("=", 1) for line in _SHORT.strip().splitlines() for pair in line.split(":", 1)[1].split(";")
)

_STOP = """
abnormal activity acute adult age alias aliase aliases analysis anterior api area article assessment
bilateral block body bone calendar case category cell change child chronic clinical code command common
complication condition config conservative content daily data day decrease development diagnosis disease disorder drug
early effect elderly evaluation evidence examination exercise extension factor female field file final finding folder form free function
group guideline header high highlight== history homepage hook hub image improvement increase index initial intervention item
joint json key label large late lateral left level link list low lower male management measure mechanism medial medication medicine
method mild model moderate month mortality muscle negative nerve normal note number organ outcome
page path patient patients pattern pediatric phase physical plugin positive post posterior primary priority procedure process prognosis project prompt
query rare rate ratio recovery reduction region report resource result review right risk scale score script search secondary section
server session setting severe sign signs small source stage string study surgical symptom symptoms system table tag tags template
test text therapy tissue title tool treatment type typical unilateral unscheduled upper url user value weak week weekday weeks year client
"""
#: Names too general to link notes by: a constant of the semantics, since bridges depend on every word of it.
STOPWORDS: frozenset[str] = frozenset(_STOP.split()) | {"pasted image", "side effect", "slash command"}

#: Semantic type codes by the kind of entity they mark (ENT-8).
TYPE_CODES: dict[str, tuple[int, ...]] = {
    "condition": (19, 20, 46, 47, 48, 190, 191), "symptom": (33, 184), "treatment": (58, 61, 65), "medication": (109, 121, 131, 195, 200),
    "anatomy": (23, 24, 25, 29, 30), "test": (34, 59, 60), "device": (74, 75, 203),
}


def type_of_code(code: str) -> str | None:
    """The kind of entity a code like "T047" marks."""
    number = int(code[1:]) if code[:1] == "T" and code[1:].isdigit() else -1
    return next((kind for kind, codes in TYPE_CODES.items() if number in codes), None)


def relation_map() -> dict[str, str]:
    return {spelling: kind for kind, spellings in RELATION_GROUPS.items() for spelling in spellings}


def intent_map() -> dict[str, str]:
    return {word: kind for kind, words in INTENT_GROUPS.items() for word in words}
