"""Table schemas of product indexes: typed fields, analysed fields, stored fields, and fields copied together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mapping:
    """``stored`` fields can't be searched. ``copies`` has, for each made field, those whose texts it gathers."""

    keywords: tuple[str, ...]
    analysed: tuple[str, ...]
    texts: tuple[str, ...]
    integers: tuple[str, ...]
    floats: tuple[str, ...]
    doubles: tuple[str, ...]
    dates: tuple[str, ...]
    stored: tuple[str, ...]
    copies: dict[str, tuple[str, ...]]

    def types(self) -> dict[str, str]:
        kinds = ((self.keywords, "string"), (self.analysed, "string"), (self.texts, "string"), (self.integers, "int"), (self.floats, "float"), (self.doubles, "double"), (self.dates, "timestamp"), (self.stored, "string"))
        return {name: kind for names, kind in kinds for name in names}

    def searchable(self) -> list[str]:
        return [*self.analysed, *self.copies]


# The fields of the two product tables.
PRODUCT_VM = Mapping(
    keywords=tuple(
        "BUNDLEKEY PRODUCTCODE SHOPCODE SHOPPRODUCTCODE PRODUCTIMAGEURL SHOPCOUPON SHOPGIFT DISCONTINUED PRICECOMPARESERVICEYN DATASTAT PRODTYPE MAKERCODE BRANDCODE MOVIEYN"
        " PRICELOCKYN NATTRIBUTEVALUESEQ UNIT SELECTYN DISPYN PRODUCTREGISTERTYPE PRICECOMPARISONSTOPYN CATEGORYDISPYN BUNDLESELECTYN EXPOSUREYN".split()
    ),
    analysed=tuple("PRODUCTNAME PRODUCTMAKER MAKERKEYWORD PRODUCTBRAND BRANDKEYWORD PRODUCTMODEL BUNDLENAME MODELWEIGHT CATEGORYWEIGHT OPTIONNAME".split()),
    texts=tuple("CATEGORYKEYWORD MANAGERKEYWORD SIMPLEDESCRIPTION ADDDESCRIPTION MOBILEDESCRIPTION RELATIONMODEL".split()),
    integers=tuple(
        "LOWESTPRICE MOBILEPRICE PCPRICE AVERAGEPRICE TOTALPRICE SHOPQUANTITY CATEGORYCODE1 CATEGORYCODE2 CATEGORYCODE3 CATEGORYCODE4 POPULARITYSCORE DELIVERYPRICE"
        " PRODUCTCLASSIFICATION BUNDLEDISPLAYSEQUENCE SAVEPLUSQ STANDARDCAPACITY PRICETYPE INITIALPRICE DISCOUNTRATE WRITECNT MAXPOPULARSCORE".split()
    ),
    floats=("TOTALCAPACITY",),
    doubles=("SHARECATE2", "SHARECATE3", "SHARECATE4"),
    dates=("REGISTERDATE", "MANUFACTUREDATE", "MODIFYDATE", "FIRSTMAKEDATE"),
    stored=tuple("CATEGORYNAME CMDESCRIPTION SIMPLEDICTIONARYCODE OPTIONTYPE BRPS ACTIONTAG DESCRIPTIONLISTSEQ IMAGEVERSION CMPNYWRITESCORESUM CMPNYWRITECNT VIDEOID CALLTIME".split()),
    copies={
        "TOTALINDEX": tuple(
            "PRODUCTNAME PRODUCTMAKER MAKERKEYWORD PRODUCTBRAND BRANDKEYWORD PRODUCTMODEL CATEGORYKEYWORD MANAGERKEYWORD BUNDLENAME SIMPLEDESCRIPTION ADDDESCRIPTION MOBILEDESCRIPTION RELATIONMODEL".split()
        ),
        "UIPRODUCTINDEX": ("PRODUCTNAME", "PRODUCTMAKER", "PRODUCTBRAND", "BUNDLENAME"),
        "MAKER_BRANDKEYWORD": ("MAKERKEYWORD", "BRANDKEYWORD"),
    },
)
PRODUCT = Mapping(
    keywords=tuple(
        "ID BUNDLEKEY PRODUCTCODE SHOPCODE SHOPPRODUCTCODE DISCONTINUED BUNDLEDISPLAYSEQUENCE DATASTAT SIMPRODHASHCODE EXPOSUREYN DISPYN PRICECOMPARISONSTOPYN CATEGORYDISPYN FEETYPE"
        " PROMOTIONNAME MAKERCODE BRANDCODE NATTRIBUTEVALUESEQ".split()
    ),
    analysed=tuple("PRODUCTNAME PRODUCTMAKER MAKERKEYWORD PRODUCTBRAND BRANDKEYWORD MODELWEIGHT CATEGORYWEIGHT".split()),
    texts=("PRODUCTMODEL", "CATEGORYKEYWORD"),
    integers=tuple(
        "LOWESTPRICE MOBILEPRICE PCPRICE TOTALPRICE SHOPQUANTITY CATEGORYCODE1 CATEGORYCODE2 CATEGORYCODE3 CATEGORYCODE4 POPULARITYSCORE DELIVERYPRICE PRODUCTCLASSIFICATION PRODTYPE"
        " WRITECNT GROUPSEQ".split()
    ),
    floats=(),
    doubles=(),
    dates=("REGISTERDATE", "MANUFACTUREDATE"),
    stored=tuple("PRODUCTIMAGEURL SHOPCOUPON SHOPGIFT SIMPRODMEMBERCNT ADDDESCRIPTION LINKURL COUPONDOWNLOADYN PROMOTIONPRICE SHOPNAME MALLTYPE MINABYN SIMPRODYN".split()),
    copies={"TOTALINDEX": ("PRODUCTNAME", "PRODUCTMAKER", "PRODUCTBRAND", "PRODUCTMODEL", "CATEGORYKEYWORD"), "MAKER_BRANDKEYWORD": ("MAKERKEYWORD", "BRANDKEYWORD")},
)


def with_copies(df: DataFrame, copies: dict[str, tuple[str, ...]]) -> DataFrame:
    """``df`` with each made field: the texts of the fields it gathers, those that there are, with spaces between."""
    made = {name: F.concat_ws(" ", *[F.col(s).cast("string") for s in sources if s in df.columns]) for name, sources in copies.items()}
    return df.withColumns(made)


def exact(column: Column, ignore_above: int = 256) -> Column:
    """The variant of a text for exact comparison, which longer texts don't have."""
    return F.when(F.length(column) <= ignore_above, column)
