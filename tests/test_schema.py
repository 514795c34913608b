"""XML Schema and RELAX NG."""

from __future__ import annotations

import pytest

from pagemill.operators.schema import RelaxNG, SchemaError, SchemaValidationError, XMLSchema, fits, validate

XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:s" xmlns="urn:s" elementFormDefault="qualified">
<xs:simpleType name="code"><xs:restriction base="xs:token"><xs:pattern value="[A-Z]{2}-\\d+"/><xs:maxLength value="6"/></xs:restriction></xs:simpleType>
<xs:simpleType name="sizes"><xs:list itemType="xs:positiveInteger"/></xs:simpleType><xs:simpleType name="mixed"><xs:union memberTypes="xs:integer code"/></xs:simpleType>
<xs:attributeGroup name="common"><xs:attribute name="id" type="xs:ID" use="required"/><xs:attribute name="kind" default="a"><xs:simpleType><xs:restriction base="xs:string"><xs:enumeration value="a"/><xs:enumeration value="b"/></xs:restriction></xs:simpleType></xs:attribute></xs:attributeGroup>
<xs:group name="parts"><xs:choice><xs:element name="x" type="xs:decimal"/><xs:element name="y" type="xs:date"/></xs:choice></xs:group>
<xs:complexType name="base"><xs:sequence><xs:element name="name" type="xs:string"/></xs:sequence><xs:attributeGroup ref="common"/></xs:complexType>
<xs:complexType name="more"><xs:complexContent><xs:extension base="base"><xs:sequence><xs:group ref="parts" maxOccurs="3"/><xs:element name="note" type="note" minOccurs="0"/><xs:element ref="item" minOccurs="0" maxOccurs="unbounded"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
<xs:complexType name="note" mixed="true"><xs:sequence><xs:any minOccurs="0" maxOccurs="unbounded" processContents="lax"/></xs:sequence><xs:anyAttribute namespace="##other"/></xs:complexType>
<xs:complexType name="price"><xs:simpleContent><xs:extension base="xs:decimal"><xs:attribute name="unit" type="xs:NMTOKEN" fixed="EUR"/></xs:extension></xs:simpleContent></xs:complexType>
<xs:element name="root" type="more"/><xs:element name="item" type="more" nillable="true"/><xs:element name="special" type="more" substitutionGroup="item"/><xs:element name="price" type="price"/><xs:element name="sizes" type="sizes"/><xs:element name="value" type="mixed"/>
<xs:element name="any"><xs:complexType><xs:all><xs:element name="p" type="xs:int"/><xs:element name="q" type="xs:boolean" minOccurs="0"/></xs:all></xs:complexType></xs:element></xs:schema>"""


def doc(body):
    return body.replace(">", ' xmlns="urn:s" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">', 1) if not body.split(">")[0].endswith("/") else body.replace("/>", ' xmlns="urn:s"/>', 1)


@pytest.mark.parametrize(
    ("body", "kinds"),
    [
        ('<root id="a"><name>n</name><x>1.5</x></root>', []), ('<root id="a" kind="b"><name>n</name><x>1</x><y>2024-02-29</y><x>2</x><note>t <b/> u</note><item id="b"><name/><x>1</x></item><special id="c"><name/><x>1</x></special></root>', []), ('<root><name>n</name><x>1</x></root>', ["attribute"]), ('<root id="a" kind="c"><name>n</name><x>1</x></root>', ["value"]),
        ('<root id="a"><x>1</x></root>', ["structure"]), ('<root id="a"><name>n</name></root>', ["structure"]), ('<root id="a"><name>n</name><x>1</x><x>1</x><x>1</x><x>1</x></root>', ["structure"]), ('<root id="a"><name>n</name><y>2023-02-29</y></root>', ["value"]), ('<root id="a"><name>n</name><x>1</x>text</root>', ["structure"]),
        ('<root id="a"><name>n</name><x>1</x><item id="a"><name/><x>1</x></item></root>', ["value"]), ('<root id="a"><name>n</name><x>1</x><item id="b" xsi:nil="true"/></root>', []), ('<root id="a" z="1"><name>n</name><x>1</x></root>', ["attribute"]), ("<other/>", ["structure"]), ('<price unit="EUR">3</price>', []), ('<price unit="USD">x</price>', ["attribute", "value"]),
        ("<sizes>1 2 3</sizes>", []), ("<sizes>1 0</sizes>", ["value"]), ("<value>12</value>", []), ("<value>AB-1</value>", []), ("<value>ab</value>", ["value"]), ("<any><q>true</q><p>1</p></any>", []), ("<any><q>true</q></any>", ["structure"]), ("<any><p>1</p><p>1</p></any>", ["structure"]), ("<any><p>3000000000</p></any>", ["value"]), ("<root", ["well-formedness"]),
    ],
)
def test_xml_schema(body, kinds):
    schema = XMLSchema(XSD)
    assert sorted(p.type for p in schema.validate(doc(body) if body != "<root" else body)) == kinds


def test_wrong_schemas_and_messages():
    for bad in ("<a/>", XSD.replace('type="more"/>', 'type="none"/>', 1).replace("xs:decimal", "xs:decimals"), XSD.replace("</xs:schema>", '<xs:import schemaLocation="x"/></xs:schema>'), XSD.replace("{2}-", "{2}-(")):
        with pytest.raises(SchemaError):
            XMLSchema(bad)
    with pytest.raises(SchemaValidationError, match=r"/root/z: element z is not expected, but name"):
        XMLSchema(XSD).assert_valid(doc('<root id="a"><z/></root>'))
    assert all(fits(v, t) for v, t in (("-P1Y2M", "duration"), ("2024-01-01T24:00:00Z", "dateTime"), ("--02-29", "gMonthDay"), ("0aF0", "hexBinary"), ("a:b", "QName"), ("INF", "double"), ("en-GB", "language")))
    assert not any(fits(v, t) for v, t in (("P", "duration"), ("2024-13-01", "date"), ("1a", "NCName"), ("0a0", "hexBinary"), ("maybe", "boolean"), ("256", "unsignedByte")))


RNG = """<grammar xmlns="http://relaxng.org/ns/structure/1.0" datatypeLibrary="http://www.w3.org/2001/XMLSchema-datatypes"><start><ref name="book"/></start>
<define name="book"><element name="book"><attribute name="id"><data type="NCName"/></attribute><optional><attribute name="lang"><choice><value>en</value><value>de</value></choice></attribute></optional>
<interleave><element name="title"><text/></element><zeroOrMore><ref name="part"/></zeroOrMore><optional><element name="sizes"><list><oneOrMore><data type="int"><param name="maxInclusive">9</param></data></oneOrMore></list></element></optional></interleave></element></define>
<define name="part"><element name="part"><mixed><zeroOrMore><choice><ref name="part"/><element><anyName><except><name>part</name><name>book</name></except></anyName><empty/></element></choice></zeroOrMore></mixed></element></define></grammar>"""


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ('<book id="a"><title>t</title></book>', []), ('<book lang="de" id="a"><part>x<part/>y<hr/></part><title>t</title><part/><sizes>1 2</sizes></book>', []), ("<book><title>t</title></book>", ["attribute"]), ('<book id="1"><title/></book>', ["attribute"]), ('<book id="a" lang="fr"><title/></book>', ["attribute"]), ('<book id="a"/>', ["structure"]),
        ('<book id="a"><title/><title/></book>', ["structure"]), ('<book id="a"><title/><sizes>10</sizes></book>', ["value"]), ('<book id="a"><title/>x</book>', ["structure"]), ('<book id="a"><title/><part><book/></part></book>', ["structure"]), ("<x/>", ["structure"]), ("", ["well-formedness"]),
    ],
)
def test_relax_ng(text, kinds):
    assert [p.type for p in RelaxNG(RNG).validate(text)] == kinds


def test_validate_rows(spark):
    df = spark.createDataFrame([(1, '<book id="a"><title>t</title></book>'), (2, "<book/>"), (3, None)], "page_id bigint, xml string")
    assert [r["valid"] for r in validate(df, RNG, "rng").orderBy("page_id").collect()] == [True, False, False]
    rows = validate(spark.createDataFrame([(1, doc("<sizes>1</sizes>")), (2, doc("<sizes>x</sizes>"))], "page_id bigint, xml string"), XSD).orderBy("page_id").collect()
    assert rows[0]["valid"] and rows[1]["errors"][0]["path"] == "/sizes"
    with pytest.raises(SchemaError):
        validate(df, "<a/>", "rng")
