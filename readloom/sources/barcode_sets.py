"""The barcode sets that ship with the engine: codes only, in tag order; tags are a prefix and a number."""

from __future__ import annotations

_A = """
AGGATC CAGGAA GTGAAC ACAGCT CCTTAG GCTTCT AGCTTG TCCAGA CCACAA CAGCTT ACAAGC GTCTCA ACGAAG GGTTAC GCTATC TAGCAG AAGTCG
ATCTGC CTCCTA TGTCCT CACTGT GATCTG ACTGTG TACTCG CAAGTG CGGAAT GACGTT GTTGAG CGCTAA ATTGCC TTGAGG TGCAAG ACCATCC
AAGTGCA AGTCCAT CAGCGTA ACGACCT CAGTCAG CCATCAA ATAGCAG AATGAGC CATTGCC AACTTCG ACTAGGC AACGTTC ACGTCAC CCAGACA
AACTGAC AACGACA AGACGTA CCACTAG AGAGTGA AGCGAAG ACGGAGA CACGGAA CATAGAG CAACTCA AATGGCG ATAGGCA CACAACG AGGCACA
AACACAG AGCCATC ACTAACG ATCCTCCA ACCTTGAC CGAAGATC ATATCGGC ATGGTCAC AACGCATG CATGAGTG AGGACATC AGAGTACG ATAGGCGA
ATCAGTGG AACCGAAC CCGACAAT AGATCGCT CATCGATC ACTCGGTA ATTAGGCG AACAGGCA CAGAGAGA CAGCCTAA ACTCGAAG ACCTAGCA ACACGTGA
CGAGTCTA AAGAAGCG CACAATGG ATCCTGTG CCTACGAA CAGTTAGG CGAGTGAT AACGGAGT AAGAGCTC
"""
_B = """
ACGGAA CCAACA AGATCG TTCTCC TTCCTG TTCGGT TTGTGG TTGCCT TTGGTC TTACGC TTAGCG TCTTCG TCTCTC TCTGGA TCCACT TCGTAC TCGATG
TCACAG TGTTGC TGTCCA TGTGTG TGCTAG TGCATC TGGAGT TGAGAC TATCGG TATGCC TACCAC TAGGAG CTTCGT CTTGCA CTCTGA CTCAAC CTGCTA
CTGGAT CTAAGG CCTCAA CCTGTT CCATTC CGTTCT CGTAGA CGGTAA CGACTT CATACG CACTTG CACGAA CACAGT CAGATC CAACGA CAAGCT GTTCAC
GTCGTA GTGTCA GTGAAG GTAACC GCTTGT GCCTAA GCACTA GCAGAT GGTGAA GGCAAT GGATGA GGAATG GATCCT GATAGC GACACA GAGCAA GAGGTT
ATTCCG ATTGGC ATCGAG ACTACC ACCAGA ACGTCT ACACGT ACAGTG AGCTGT AGCCTA AGGTTC AGGCAT AGGACA AGAAGC AACGTC AAGCTG CGAGTA
GAATCC GAATGG AAGTGC AAGAGG TACAGG CTGACT CTAGTC CCTAAG CCATAG CGTAAC CAATGC
"""
_C = """
GTAAGGC AACGACA ACTGTAG TCGGCTT GCCAACA CGTAGGA TAGGAGC GAGTACG GCAACTA TAGAGGT AGGATCT CCTACAA ATGCGAC ACACCGA
TGTCTGC AGGTTAG AGTTGTG ACTTGAC GAGGCTA CTAACGA TGCTTCT TCGTCAA GACTGCT GCGATAA CAGGTAG CCTCAAC AACCTTG GCTGCAT
GCACAAT CTTCCAT AGAAGCC CACATCT CTATCCT CACTCAA GGTATAG CTGGCAA GTGAACC ATACGGT GGCTTGA AGGACAA CAAGCAT AGTCACA
GGTTACT GAAGAAG CGCTAAT ACCTTCA GAACACC TTCGGTA CATCGAG GCTAAGC CACTGTG TACACGA TGATGAG CAGGACT ACGAACG TGGCGAA
CAGCCTT CTCCACT GGTGAAC AATGGCT GTCCAAG ACCGCTA GGCAATG CAACTGT AATGCGA AGCTCAC GTTCCGA CCATTGA GAGAAGA ACGCCAT
TGCAGCA ACGATGC CCGAAGT TGAGCAA AGATAGC CGTGTTG ACGTCTG CGAATCG GTAACCG GCATTCC AGCCTGT AGTCCAG AGTGGAA CATGGTA
CCATACG GCCTAAC AAGGCAC ATACACG AGTGTCC GAATGGA AAGTGCA GCGTATA TGCCTAG TGAGATG TTCCTGA CTAAGAG
"""
_D = """
CGTTTC TGGTGT TCTCGA GAAGGA GAACAG GAAACC CAACCA CAAAGG CAAGAC TAAGCG TAACGC AGACGA AGAGAG AGATCC GGAAGT CGAGTA CGACAT
TGACTG ACAGCA ACATGG ACACAC GCACTA GCAGAT CCAACT TCAGTC ATACCG ATAGGC GTAGTG CTACTC AAGACG AAGTGC GAGTCA GAGGTT CAGTAG
CAGATC TAGCCT AGGTTG AGGAAC TGGGAA ACGAGA ACGTCT CCGTTA TCGAAG ATGCGT GTGCAA GTGTTC GTGACT CTGGAT TTGTCG TTGAGC AACGTG
GACTAC CACTGA CACCTT TACGGT AGCACA GGCTTA TGCTAG TGCATC ACCTTC GCCATT TCCTCA TCCCAT ATCAGG ATCGCT GTCTGT CTCTTG CTCAAC
AATCGG AATGCC GATCTC AGTGGT GGTTCT CGTAGA TGTACG TGTCAC GCTACA GCTTAG CCTGAA CCTATG CCTTGT TCTGCT GTTGAC CTTCAG TCGTAC
TTCGGA TTCCCA CTTGCA CTTCCT GTACCT CAGAGT TAGGAC AGGCTT TGGCTA ACGGTT TTGGCA
"""
_PLATE_7 = """
CGATCTA TAGAGAG GAGGATA CTACTCT TCCTTAC ATGCAGT ACTCCTT GGCTTAG GATACTC ACTCCAT TGTCTGC GCTTGGA
"""


def _numbered(letter: str, text: str, first: int = 1, width: int = 2) -> list[tuple[str, str]]:
    return [(f"{letter}{i:0{width}d}", code) for i, code in enumerate(text.split(), first)]


#: Set name to (tag, code) in file order.
SHIPPED: dict[str, list[tuple[str, str]]] = {
    "A": _numbered("A", _A),
    "B": _numbered("B", _B),
    "C": _numbered("C", _C),
    "D": _numbered("D", _D),
    "stagger": [("S2", "AGATGTGTAT"), ("S1", "GATGTGTATA"), ("S0", "ATGTGTATAA")],
    "plate8": [("N501", "GCGATCTA"), ("N502", "ATAGAGAG"), ("P999", "GGGGGGGG")],
    "plate7": _numbered("N", _PLATE_7, 501, 3),
}
#: The tag of what can't be told.
UNCLEAR = {"A": "A00", "B": "B00", "C": "C00", "D": "D00", "stagger": "S00", "plate8": "P000", "plate7": "P000"}
