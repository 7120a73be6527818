"""Sentences of many languages and scripts, put together at random; how well the splitter finds where they begin.

`python -m tests.llm.planted` prints recall and precision by language and by kind of the place before a sentence.
"""

from __future__ import annotations

import random
from collections import defaultdict

from packetloom.llm.sentences import sentences

#: language: what stands between sentences, and sentences as (kind of their end, text).
PLANTED: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "English": (" ", [("stop", "The lamp was lit."), ("question", "Who left it on?"), ("quotation", "She said: “We go. Come along.”"), ("abbreviation", "Dr. Hale came at 5 p.m. with J. Moss."), ("number", "It weighs 3.14 kg, cf. No. 7."), ("ellipsis", "Well..."), ("abbreviation", "They sell lamps, cords, etc."), ("label", "We follow plan B.")]),
    "German": (" ", [("stop", "Der Hund schläft."), ("number", "Am 3. Mai kam er, d. h. zu spät."), ("question", "Wer ist da?"), ("abbreviation", "Wir haben Äpfel, Birnen usw."), ("quotation", "„Komm!“, rief sie."), ("abbreviation", "Das kostet z. B. ca. 4 Euro.")]),
    "French": (" ", [("stop", "Le chat dort."), ("question", "Où est-il ?"), ("quotation", "Il dit : « Viens ici. »"), ("abbreviation", "Voir p. ex. M. Roux.")]),
    "Spanish": (" ", [("stop", "La casa es grande."), ("question", "¿Dónde está?"), ("exclamation", "¡No lo toques!"), ("abbreviation", "Lo vio la Sra. Ruiz en la pág. 12.")]),
    "Russian": (" ", [("stop", "Дом стоит у реки."), ("question", "Кто там?"), ("quotation", "«Где?» — спросил он."), ("abbreviation", "Это т. е. так, см. рис. 4.")]),
    "Greek": (" ", [("stop", "Το σπίτι είναι μεγάλο."), ("question", "Πού πας;"), ("abbreviation", "Δες π.χ. αυτό· έπειτα φύγε.")]),
    "Polish": (" ", [("stop", "Kot śpi w domu."), ("question", "Gdzie jest dom?"), ("abbreviation", "Mam np. dwa psy, tj. zwierzęta.")]),
    "Czech": (" ", [("stop", "Pes běží domů."), ("exclamation", "Pojď sem!"), ("number", "Je to 3,5 metru.")]),
    "Bulgarian": (" ", [("stop", "Котката спи."), ("question", "Къде отиваш?")]),
    "Vietnamese": (" ", [("stop", "Tôi đi học."), ("question", "Anh ở đâu?")]),
    "Turkish": (" ", [("stop", "Kedi uyuyor."), ("question", "Nereye gidiyorsun?")]),
    "Arabic": (" ", [("stop", "البيت كبير."), ("question", "أين القط؟"), ("quotation", "قال: «اذهب الآن».")]),
    "Urdu": (" ", [("stop", "گھر بڑا ہے۔"), ("question", "وہ کہاں ہے؟")]),
    "Persian": (" ", [("stop", "خانه بزرگ است."), ("question", "او کجاست؟")]),
    "Hebrew": (" ", [("stop", "הבית גדול."), ("question", "איפה הוא?")]),
    "Hindi": (" ", [("stop", "घर बड़ा है।"), ("question", "वह कहाँ है?"), ("abbreviation", "डॉ. राव आए।"), ("quotation", "उसने कहा, “चलो।”")]),
    "Hindi with dots": (" ", [("stop", "मैं जाता हूँ."), ("stop", "वह घर आता है.")]),
    "Bengali": (" ", [("stop", "আমি যাই।"), ("question", "তুমি কোথায়?")]),
    "Punjabi": (" ", [("stop", "ਮੈਂ ਜਾਂਦਾ ਹਾਂ।"), ("stop", "ਉਹ ਆਉਂਦਾ ਹੈ।")]),
    "Gujarati": (" ", [("stop", "હું જાઉં છું."), ("question", "તે ક્યાં છે?")]),
    "Tamil": (" ", [("stop", "நான் வருகிறேன்."), ("question", "அவன் எங்கே?")]),
    "Telugu": (" ", [("stop", "నేను వస్తాను."), ("stop", "అతను వెళ్తాడు.")]),
    "Kannada": (" ", [("stop", "ನಾನು ಬರುತ್ತೇನೆ."), ("stop", "ಅವನು ಹೋಗುತ್ತಾನೆ.")]),
    "Malayalam": (" ", [("stop", "ഞാൻ വരുന്നു."), ("stop", "അവൻ പോകുന്നു.")]),
    "Sinhala": (" ", [("stop", "මම එනවා."), ("stop", "ඔහු යනවා.")]),
    "Chinese": ("", [("stop", "他在家。"), ("question", "你是谁？"), ("quotation", "他说：“先走。再来！”"), ("ellipsis", "很慢……但是可用。")]),
    "Japanese": ("", [("stop", "猫がいる。"), ("question", "誰ですか？"), ("quotation", "彼は「行け。早く！」と言った。")]),
    "Korean": (" ", [("stop", "저는 갑니다."), ("question", "어디 있어요?")]),
    "Thai": (" ", [("blank", "แมวนอนอยู่"), ("blank", "มี 90 งานรออยู่"), ("blank", "บ้านหลังใหญ่")]),
    "Lao": (" ", [("blank", "ແມວນອນ"), ("blank", "ເຮືອນໃຫຍ່")]),
    "Khmer": (" ", [("stop", "ខ្ញុំទៅផ្ទះ។"), ("stop", "គាត់មកហើយ។")]),
    "Burmese": (" ", [("stop", "ကျွန်တော် သွားသည်။"), ("stop", "သူ ၊ လာသည်။")]),
    "Tibetan": (" ", [("stop", "ང་འགྲོ།"), ("stop", "ཁོ་ཡོང་།")]),
    "Mongolian": (" ", [("stop", "ᠪᠢ ᠶᠠᠪᠤᠨ᠎ᠠ᠃"), ("stop", "ᠲᠡᠷᠡ ᠢᠷᠡᠨ᠎ᠡ᠃")]),
    "Amharic": (" ", [("stop", "ቤቱ ትልቅ ነው።"), ("question", "እሱ የት ነው?")]),
    "Armenian": (" ", [("stop", "Տունը մեծ է։"), ("stop", "Նա գնում է։")]),
    "Georgian": (" ", [("stop", "მე მივდივარ."), ("question", "სად არის?")]),
    "Syriac": (" ", [("stop", "ܒܝܬܐ ܪܒ܀"), ("stop", "ܗܘ ܐܬܐ܀")]),
}


def texts(seed: int = 5, each: int = 20, size: int = 8):
    """language, text, and the kind of the place before the sentence that begins at each offset."""
    r = random.Random(seed)
    for language, (gap, stock) in PLANTED.items():
        for _ in range(each):
            text, begins, kind = "", {}, "first"
            for _ in range(size):
                own, said = r.choice(stock)
                if text:
                    text += gap
                begins[len(text)] = kind
                text, kind = text + said, own
            yield language, text, begins


def measured(**how) -> tuple[dict, dict]:
    """(true, found, both) by language and, for what was to be found, by kind."""
    by_language, by_kind = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0])
    for language, text, begins in texts(**how):
        got = {a for a, _ in sentences(text)}
        for n, x in enumerate((begins, got, got & set(begins))):
            by_language[language][n] += len(x)
        for at, kind in begins.items():
            by_kind[kind][0] += 1
            by_kind[kind][1] += at in got
    return by_language, by_kind


if __name__ == "__main__":
    languages, kinds = measured()
    for name, (true, found, both) in languages.items():
        print(f"| {name} | {true} | {both / true:.3f} | {both / found:.3f} |")
    for name, (true, both) in kinds.items():
        print(f"| after {name} | {true} | {both / true:.3f} |")
