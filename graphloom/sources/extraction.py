"""Extraction documents (JSON per file) as frames of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify, recover
from ..operators.incremental import first_wins
from ..session import durable

#: The documents' schemas (fixed values).
CONTRACTS = {
    "structure": """programId string, executionMode string, copyReferences array<string>, callTargets array<struct<target:string,isDynamic:boolean>>, paragraphs array<string>, sections array<string>,
      fileDefinitions array<struct<name:string,organization:string,vsamType:string,dataStoreType:string>>, dataItems array<struct<name:string,level:int,picture:string,usage:string>>,
      conditions array<struct<name:string,parent:string,value:string>>, parameters array<struct<name:string,level:int,direction:string>>, sqlStatements array<struct<type:string,text:string,targetTable:string>>,
      cicsCommands array<struct<command:string>>, externalInterfaces array<struct<type:string,details:string,paragraph:string>>, dbTables array<struct<name:string,schema:string,columns:array<string>,operations:array<string>>>,
      idmsSchemas array<struct<schemaName:string,subschemaName:string,protocolMode:string>>, idmsRecords array<struct<name:string,area:string>>, idmsAreas array<struct<name:string,usageMode:string>>,
      idmsSets array<struct<name:string,ownerRecord:string,memberRecord:string>>""",
    "behaviour": """performs array<struct<fromParagraph:string,toParagraph:string,thruParagraph:string,isLoop:boolean,condition:string>>, dataFlows array<struct<fromItem:string,toItem:string,context:string>>,
      fileOperations array<struct<operation:string,fileName:string,paragraph:string>>, dataHierarchy array<struct<name:string,level:int,parent:string,picture:string,copybook:string>>, redefines array<struct<item:string,redefines:string>>,
      copybookDefinitions array<struct<dataItem:string,copybook:string>>, annotations array<struct<paragraph:string,description:string,category:string>>, conditionalLogic array<struct<paragraph:string,condition:string,variables:array<string>,type:string>>,
      dynamicCallResolution array<struct<variable:string,resolvedTargets:array<string>,paragraph:string>>, errorHandling array<struct<paragraph:string,pattern:string,details:string>>,
      idmsOperations array<struct<verb:string,record:string,area:string,set:string,paragraph:string,usageMode:string>>""",
    "estate": """domains array<struct<name:string,description:string,programs:array<struct<programId:string,confidence:double>>>>, deadCode array<struct<programId:string,reason:string>>,
      riskFlags array<struct<programId:string,riskType:string,details:string,score:double>>, bridgePrograms array<struct<programId:string,domains:array<string>,reason:string>>,
      copybookRisk array<struct<copybook:string,programCount:int,riskLevel:string,reason:string>>, volumeEstimates array<struct<programId:string,estimate:string,reason:string>>""",
    "job": """jobName string, class string, msgclass string, steps array<struct<stepName:string,pgm:string,proc:string,cond:string,ddCards:array<struct<ddName:string,dsname:string,disp:string,isInput:boolean,isOutput:boolean>>>>""",
    "middleware": """summary string, entities array<struct<name:string,entityType:string,description:string,properties:map<string,string>>>,
      relationships array<struct<fromEntity:string,toEntity:string,relationType:string,description:string,confidence:double>>,
      cobolReferences array<struct<entityName:string,targetName:string,targetType:string,referenceType:string,description:string>>""",
    "field_mapping": "fieldMappings array<struct<sourceField:string,targetField:string,transform:string>>",
    "repair": """childOfRelationships array<struct<child:string,childLevel:int,parent:string,parentLevel:int>>, dataFlows array<struct<fromItem:string,toItem:string,context:string>>,
      calls array<struct<target:string,isDynamic:boolean,fromParagraph:string,resolvedFrom:string>>, annotations array<struct<paragraph:string,description:string,category:string>>,
      verifications array<struct<paragraphName:string,verdict:string,reason:string>>, decisions array<struct<domain1:string,domain2:string,action:string,keepDomain:string,reason:string>>""",
    "middleware_links": """newCobolReferences array<struct<entityMergeId:string,targetName:string,targetType:string,referenceType:string,description:string,confidence:double>>,
      crossFileRelationships array<struct<fromMergeId:string,toMergeId:string,relationType:string,description:string>>, clusters array<struct<name:string,description:string,entityMergeIds:array<string>>>,
      repairs array<struct<entityMergeId:string,targetName:string,targetType:string,referenceType:string,description:string,confidence:double,action:string>>""",
    "external": """externalTables array<struct<name:string,schema:string,columns:array<struct<name:string,dataType:string,nullable:boolean,isPK:boolean>>>>,
      mappings array<struct<cobolTable:string,externalTable:string,confidence:double,reason:string,columnMappings:array<struct<cobolColumn:string,externalColumn:string,transform:string>>>>,
      gaps array<struct<side:string,tableName:string,columnName:string,description:string>>, dataFlows array<struct<cobolProgram:string,operation:string,db2Table:string,externalTable:string,flowType:string,description:string>>""",
    "target": """services array<struct<name:string,serviceType:string,description:string,basePath:string,language:string,framework:string>>, endpoints array<struct<method:string,path:string,description:string,serviceName:string,parameters:string>>,
      rules array<struct<name:string,description:string,category:string,serviceName:string,confidence:double>>, dataModels array<struct<name:string,description:string,serviceName:string,fields:string,tableName:string>>,
      integrations array<struct<integrationType:string,target:string,description:string,serviceName:string>>, errorHandlers array<struct<pattern:string,description:string,serviceName:string>>""",
}
#: What a verb does to a file or a record, as an edge type (fixed values); other file verbs write.
FILE_EDGES = {"READ": "READS", "START": "READS"}
RECORD_EDGES = {"OBTAIN": "NAVIGATES", "FIND": "NAVIGATES", "GET": "NAVIGATES", "STORE": "STORES_IN", "MODIFY": "MODIFIES", "ERASE": "ERASES", "CONNECT": "CONNECTS", "DISCONNECT": "DISCONNECTS", "READY": "READIES", "BIND": "BINDS_TO"}

#: contract -> frame -> (array, columns over its element x, its position i, the document's key k, program p and body r).
FRAMES = {
    "structure": {
        "calls": ("callTargets", {"src": "p", "dst": "upper(trim(x.target))", "is_dynamic": "coalesce(x.isDynamic, false)"}, "dst"),
        "includes": ("copyReferences", {"program": "p", "copybook": "upper(trim(x))"}, "copybook"),
        "paragraphs": ("paragraphs", {"id": "concat(p, '.', x)", "name": "x", "program": "p"}, "name"),
        "sections": ("sections", {"id": "concat(p, '.', x)", "name": "x", "program": "p"}, "name"),
        "files": ("fileDefinitions", {"name": "x.name", "program": "p", "organization": "x.organization", "store": "x.dataStoreType"}, "name"),
        "items": ("dataItems", {"fqn": "concat(p, '.', lpad(coalesce(x.level, 0), 2, '0'), '.', x.name)", "name": "x.name", "level": "x.level", "picture": "x.picture", "usage": "x.usage", "program": "p"}, "name"),
        "conditions": ("conditions", {"id": "concat(p, '.', x.name)", "name": "x.name", "parent": "x.parent", "value": "x.value", "program": "p"}, "name"),
        "parameters": ("parameters", {"id": "concat(p, '.', x.name)", "name": "x.name", "level": "x.level", "direction": "x.direction", "program": "p"}, "name"),
        "statements": ("sqlStatements", {"id": "sha2(concat_ws('|', p, x.type, x.text), 256)", "type": "x.type", "text": "x.text", "tab": "x.targetTable", "program": "p"}, "text"),
        "commands": ("cicsCommands", {"program": "p", "command": "x.command"}, "command"),
        "interfaces": ("externalInterfaces", {"id": "sha2(concat_ws('|', p, x.type, x.details), 256)", "type": "x.type", "details": "x.details", "paragraph": "x.paragraph", "program": "p"}, "type"),
        "accesses": ("dbTables", {"program": "p", "tab": "x.name", "schema_name": "x.schema", "operations": "x.operations", "columns": "x.columns"}, "tab"),
        "records": ("idmsRecords", {"program": "p", "name": "x.name", "area": "x.area"}, "name"),
        "areas": ("idmsAreas", {"program": "p", "name": "x.name", "usage_mode": "x.usageMode"}, "name"),
        "sets": ("idmsSets", {"program": "p", "name": "x.name", "owner": "x.ownerRecord", "member": "x.memberRecord"}, "name"),
        "schemas": ("idmsSchemas", {"program": "p", "name": "x.schemaName", "subschema": "x.subschemaName", "protocol": "x.protocolMode"}, "name"),
    },
    "behaviour": {
        "performs": ("performs", {"program": "p", "src": "x.fromParagraph", "dst": "x.toParagraph", "thru": "x.thruParagraph", "is_loop": "coalesce(x.isLoop, false)", "condition": "x.condition"}, "dst"),
        "moves": ("dataFlows", {"program": "p", "src": "x.fromItem", "dst": "x.toItem", "context": "x.context"}, "dst"),
        "file_edges": ("fileOperations", {"program": "p", "file": "x.fileName", "verb": "upper(x.operation)", "paragraph": "x.paragraph"}, "file"),
        "children": ("dataHierarchy", {"program": "p", "name": "x.name", "level": "x.level", "parent": "x.parent", "copybook": "x.copybook"}, "name"),
        "redefines": ("redefines", {"program": "p", "item": "x.item", "redefined": "x.redefines"}, "item"),
        "definitions": ("copybookDefinitions", {"program": "p", "item": "x.dataItem", "copybook": "upper(x.copybook)"}, "copybook"),
        "annotations": ("annotations", {"program": "p", "paragraph": "x.paragraph", "description": "x.description", "category": "x.category"}, "paragraph"),
        "logic": ("conditionalLogic", {"program": "p", "paragraph": "x.paragraph", "condition": "x.condition", "type": "upper(x.type)"}, "paragraph"),
        "resolved": ("dynamicCallResolution", {"program": "p", "variable": "x.variable", "targets": "x.resolvedTargets", "paragraph": "x.paragraph"}, "variable"),
        "handlers": ("errorHandling", {"program": "p", "paragraph": "x.paragraph", "pattern": "x.pattern", "details": "x.details"}, "paragraph"),
        "record_edges": ("idmsOperations", {"program": "p", "record": "x.record", "area": "x.area", "verb": "upper(x.verb)", "usage_mode": "x.usageMode"}, "verb"),
    },
    "estate": {
        "domains": ("domains", {"name": "x.name", "description": "x.description", "members": "x.programs"}, "name"),
        "dead": ("deadCode", {"program": "x.programId", "reason": "x.reason"}, "program"),
        "risks": ("riskFlags", {"program": "x.programId", "type": "x.riskType", "details": "x.details", "score": "x.score"}, "program"),
        "bridges": ("bridgePrograms", {"program": "x.programId", "domains": "x.domains", "reason": "x.reason"}, "program"),
        "copybook_risks": ("copybookRisk", {"copybook": "x.copybook", "programs": "x.programCount", "level": "upper(x.riskLevel)", "reason": "x.reason"}, "copybook"),
        "volumes": ("volumeEstimates", {"program": "x.programId", "estimate": "upper(x.estimate)", "reason": "x.reason"}, "program"),
    },
    "job": {
        "steps": ("steps", {"job": "r.jobName", "step": "coalesce(nullif(x.stepName, ''), concat('STEP', lpad(i + 1, 3, '0')))", "seq": "i + 1", "program": "upper(x.pgm)", "cards": "x.ddCards"}, "job"),
    },
    "middleware": {
        "entities": ("entities", {"id": "concat(k, '.', x.name)", "name": "x.name", "type": "x.entityType", "description": "x.description", "properties": "x.properties"}, "name"),
        "relations": ("relationships", {"src": "x.fromEntity", "dst": "x.toEntity", "type": "x.relationType", "confidence": "coalesce(nullif(x.confidence, 0D), 0.5D)"}, "dst"),
        "references": ("cobolReferences", {"entity": "x.entityName", "target": "upper(x.targetName)", "target_type": "coalesce(nullif(x.targetType, ''), 'Program')", "type": "x.referenceType"}, "target"),
    },
    "field_mapping": {"pairs": ("fieldMappings", {"src": "x.sourceField", "dst": "x.targetField", "transform": "x.transform"}, "src")},
    "repair": {
        # an end that isn't named leaves no edge
        "children": ("childOfRelationships", {"src": "if(x.parent <> '' and x.child <> '', format_string('%s.%02d.%s', p, coalesce(x.childLevel, 0), upper(x.child)), null)", "dst": "format_string('%s.%02d.%s', p, coalesce(x.parentLevel, 0), upper(x.parent))"}, "src"),
        "moves": ("dataFlows", {"src": "if(x.toItem <> '', concat(p, '.', upper(nullif(x.fromItem, ''))), null)", "dst": "concat(p, '.', upper(x.toItem))", "context": "x.context"}, "src"),
        "calls": ("calls", {"src": "p", "dst": "upper(x.target)", "is_dynamic": "coalesce(x.isDynamic, false)", "from_paragraph": "x.fromParagraph", "resolved_from": "x.resolvedFrom"}, "dst"),
        "annotations": ("annotations", {"program": "p", "paragraph": "x.paragraph", "description": "x.description", "category": "x.category"}, "paragraph"),
        "verdicts": ("verifications", {"program": "p", "paragraph": "x.paragraphName", "false_positive": "coalesce(x.verdict = 'false_positive', false)", "reason": "x.reason"}, "paragraph"),
        "merges": ("decisions", {"a": "x.domain1", "b": "x.domain2", "merge": "coalesce(x.action = 'merge', false)", "keep": "x.keepDomain", "reason": "x.reason"}, "a"),
    },
    "middleware_links": {
        "references": ("newCobolReferences", {"entity": "if(x.targetName <> '', x.entityMergeId, null)", "target": "x.targetName", "target_type": "x.targetType", "type": "x.referenceType", "confidence": "coalesce(nullif(x.confidence, 0D), 0.5D)"}, "entity"),
        "relations": ("crossFileRelationships", {"src": "if(x.toMergeId <> '', x.fromMergeId, null)", "dst": "x.toMergeId", "type": "x.relationType"}, "src"),
        "clusters": ("clusters", {"name": "if(size(x.entityMergeIds) > 0, x.name, null)", "entities": "x.entityMergeIds", "description": "x.description"}, "name"),
        "repairs": ("repairs", {"entity": "if(coalesce(x.action, '') <> 'reject', x.entityMergeId, null)", "target": "x.targetName", "target_type": "x.targetType", "type": "x.referenceType", "confidence": "coalesce(nullif(x.confidence, 0D), 0.5D)", "action": "x.action"}, "entity"),
    },
    "external": {
        "tables": ("externalTables", {"id": "lower(concat_ws('.', k, x.schema, x.name))", "name": "x.name", "schema_name": "x.schema", "columns": "x.columns"}, "name"),
        "mappings": ("mappings", {"tab": "x.cobolTable", "external": "x.externalTable", "confidence": "x.confidence", "reason": "x.reason", "columns": "x.columnMappings"}, "tab"),
        "gaps": ("gaps", {"side": "x.side", "tab": "x.tableName", "field": "x.columnName", "description": "x.description"}, "side"),
        "flows": ("dataFlows", {"program": "x.cobolProgram", "operation": "x.operation", "tab": "x.db2Table", "external": "x.externalTable", "type": "x.flowType"}, "program"),
    },
    "target": {
        "services": ("services", {"id": "concat(k, '::', x.name)", "name": "x.name", "type": "x.serviceType", "base_path": "x.basePath", "language": "x.language", "framework": "x.framework"}, "name"),
        "endpoints": ("endpoints", {"id": "concat_ws('::', k, x.serviceName, x.method, x.path)", "method": "upper(x.method)", "path": "x.path", "service": "x.serviceName"}, "path"),
        # a rule of low confidence is none
        "rules": ("rules", {"id": "concat_ws('::', k, x.serviceName, x.name)", "name": "if(x.confidence >= 0.5, x.name, null)", "category": "x.category", "service": "x.serviceName", "confidence": "x.confidence"}, "name"),
        "models": ("dataModels", {"id": "concat_ws('::', k, x.serviceName, x.name)", "name": "x.name", "service": "x.serviceName", "fields": "x.fields", "tab": "x.tableName"}, "name"),
        "integrations": ("integrations", {"id": "concat_ws('::', k, x.serviceName, x.integrationType, x.target)", "type": "x.integrationType", "target": "x.target", "service": "x.serviceName"}, "target"),
        "handlers": ("errorHandlers", {"id": "concat_ws('::', k, x.serviceName, x.pattern)", "pattern": "x.pattern", "service": "x.serviceName"}, "pattern"),
    },
}


def parse(docs: DataFrame, contract: str) -> DataFrame:
    """(key, program, body, partial): ``docs`` (key, program, json) read by the contract's schema.

    What isn't valid JSON is recovered as far as possible and marked partial; what can't be read drops out, and so do
    null keys. The program comes from the document where it names one.
    """
    fixed = docs.where("key is not null and json is not null").withColumn("__fixed", recover.recovered("json"))
    body = F.from_json("__fixed", CONTRACTS[contract])
    rows = fixed.select("key", "program", body.alias("body"), (F.col("__fixed") != F.col("json")).alias("partial")).where("body is not null")
    if contract == "structure":
        rows = rows.withColumn("program", F.upper(F.coalesce(F.nullif(F.trim("body.programId"), F.lit("")), "program", F.lit("UNKNOWN"))))
    return durable(rows)


def frames(parsed: DataFrame, contract: str) -> dict[str, DataFrame]:
    """Every array of the contract as a frame; elements without the column that names them drop out, repeated rows count once."""
    out = {}
    for name, (array, columns, needed) in FRAMES[contract].items():
        rows = parsed.select(F.col("key").alias("k"), F.col("program").alias("p"), F.col("body").alias("r"), F.posexplode(f"body.{array}").alias("i", "x"))
        named = rows.select(F.col("k").alias("key"), F.col("i").alias("at"), *[F.expr(e).alias(c) for c, e in columns.items()])
        out[name] = named.where(F.col(needed).isNotNull() & (F.trim(F.col(needed).cast("string")) != ""))
    if contract == "behaviour":
        out["file_edges"] = out["file_edges"].withColumn("type", _edge("verb", FILE_EDGES, F.lit("WRITES")))
        out["record_edges"] = out["record_edges"].withColumn("type", _edge("verb", RECORD_EDGES, F.col("verb")))
    if contract == "estate":
        out["members"] = out["domains"].select("key", F.col("name").alias("domain"), F.explode("members").alias("m")).select("key", "domain", F.col("m.programId").alias("program"), F.col("m.confidence").alias("confidence")).where("program is not null")
        out["domains"] = out["domains"].drop("members")
    if contract == "target":
        for name, column, family in (("services", "type", "service"), ("rules", "category", "rule"), ("integrations", "type", "integration"), ("handlers", "pattern", "error")):
            out[name] = out[name].withColumn(column, classify.synonym(F.col(column), family))
    if contract == "job":
        out["cards"] = out["steps"].select("job", "step", F.posexplode("cards").alias("at", "c")).select("job", "step", "at", F.col("c.ddName").alias("name"), F.col("c.dsname").alias("dsname"), F.col("c.disp").alias("disp"), F.col("c.isInput").alias("is_input"), F.col("c.isOutput").alias("is_output")).where("name is not null")
        out["steps"] = out["steps"].drop("cards")
    return out


def _edge(column: str, known: dict[str, str], other: Column) -> Column:
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), other)


def completeness(parsed: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, score): 1 less penalties for no or an unknown program, an unknown mode, few paragraphs or items for the lines there are, and recovery; ``lines`` has key and line_count."""
    b = parsed.join(lines.select("key", "line_count"), "key", "left")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    few = lambda c, per, part: (F.floor(F.col("line_count") / per) > 0) & (n(c) < F.floor(F.floor(F.col("line_count") / per) / part))
    off = lambda cond, by: F.when(cond, by).otherwise(0.0)
    score = (
        F.lit(1.0) - F.when(F.col("program").isNull(), 0.5).when(F.col("program") == "UNKNOWN", 0.1).otherwise(0.0) - off(F.upper("body.executionMode") == "UNKNOWN", 0.05) - off(few("body.paragraphs", 100, 2), 0.1) - off(few("body.dataItems", 60, 3), 0.1) - off(F.col("partial"), 0.2)
    )
    return b.select("key", F.round(F.greatest(score, F.lit(0.0)), 6).alias("score"))


#: Phrases that say nothing about a paragraph (fixed values).
GENERIC = ("main processing", "performs processing", "handles processing", "does processing", "main logic", "performs main")


def behaviour_score(parsed: DataFrame, known: DataFrame) -> DataFrame:
    """(key, score): 1 less 0.01 for every end of a PERFORM that is no known paragraph, 0.02 for every generic annotation and
    0.2 for recovery, 0 at least. ``known``: key, name; a key without known paragraphs isn't checked for them."""
    names = known.where("name is not null").select("key", F.upper("name").alias("name")).distinct()
    ends = parsed.select("key", F.explode("body.performs").alias("x")).select("key", F.explode(F.array("x.fromParagraph", "x.toParagraph")).alias("e")).where("e <> ''").select("key", F.upper("e").alias("name"))
    strange = ends.join(names.select("key").distinct(), "key", "left_semi").join(names, ["key", "name"], "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("strange"))
    generic = F.size(F.filter(F.coalesce("body.annotations", F.array().cast("array<struct<paragraph:string,description:string,category:string>>")), lambda a: F.coalesce(F.lower(a["description"]).rlike("|".join(GENERIC)), F.lit(False))))
    score = F.lit(1.0) - 0.01 * F.coalesce("strange", F.lit(0)) - 0.02 * generic - F.when(F.col("partial"), 0.2).otherwise(0.0)
    return parsed.join(strange, "key", "left").select("key", F.round(F.greatest(score, F.lit(0.0)), 6).alias("score"))


def estate_score(parts: dict[str, DataFrame], expected: int) -> float:
    """1 less half of what domains leave uncovered below four fifths of the programs, and 0.1 each for risks and volumes below that; 0 at least."""
    n = {name: parts[name].select("program").distinct().count() for name in ("members", "risks", "volumes")}
    share = {name: x / expected if expected > 0 else 1.0 for name, x in n.items()}
    off = (1 - share["members"]) * 0.5 if share["members"] < 0.8 else 0.0
    return max(0.0, 1.0 - off - 0.1 * (share["risks"] < 0.8) - 0.1 * (share["volumes"] < 0.8))


#: What makes two rows of a file's chunks the same (fixed values); statements and commands are all kept.
SAME = {
    "performs": ["src", "dst", "thru"], "moves": ["src", "dst", "context"], "file_edges": ["verb", "file", "paragraph"], "children": ["name", "parent"], "redefines": ["item", "redefined"], "definitions": ["item", "copybook"],
    "logic": ["paragraph", "condition"], "resolved": ["variable"], "handlers": ["paragraph"],
}


def merged(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The frames of several chunks of a program as one: the first of rows that are the same by ``SAME``, in the order of
    chunk (``key``) and position; of a paragraph's annotations the longest, the first of equally long ones."""
    out = {name: first_wins(df, ["program", *SAME[name]], ["key", "at"]) if name in SAME else df for name, df in parts.items()}
    if "annotations" in parts:
        long = parts["annotations"].withColumn("__short", -F.length(F.coalesce("description", F.lit(""))))
        out["annotations"] = first_wins(long, ["program", "paragraph"], ["__short", "key", "at"]).drop("__short")
    return out
